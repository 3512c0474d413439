import math
import random
import re
import time
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from quillgrid.llm import audit, language, lexical, license, quality, secrets, setjoin
from quillgrid.llm.shared import sample_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
GAP, TERM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def slow_search(docs, items, k=20):
    terms = lambda t: re.findall(TERM, (t or "").translate(LOW))
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in own:
            m = 75 + (25 * size * n) // length
            s = sum(many * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, many in Counter(terms(text)).items() if c[t])
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    rows = docs.select("doc_id", "text").collect()
    want = slow_search([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in lexical.search(docs.repartition(5), items).collect()), key=str) == want


def test_search_odd_rows(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "one TWO two ½ café"), (2, None), (3, "?!"), (4, "word7 and more"), (1, "four"), (None, "one")], "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = slow_search(rows, [tuple(r) for r in items.collect() if r.text])
    assert sorted((tuple(r) for r in lexical.search(odd, items).collect()), key=str) == want
    assert lexical.search(none, items).count() == 0 == lexical.search(odd, items.where("false")).count()
    monkeypatch.setattr(lexical, "ITEM_BYTES", 10)  # several passes give the same
    assert sorted((tuple(r) for r in lexical.search(odd, items).collect()), key=str) == want


def test_best_keeps_ties_by_id():
    ids, none = np.array([5, 3, 9, 1, 0]), np.array([False, False, False, False, True])
    assert ids[lexical.best(ids, none, np.array([7, 7, 8, 7, 7]), 3)].tolist() == [9, 1, 3]
    assert lexical.best(ids, none, np.zeros(5, dtype=np.int64), 3).tolist() == []
    big = np.array([2**62, 2**62 - 1, 1, 0, 0])
    assert lexical.best(ids, none, big, 2).tolist() == [0, 1]


def slow_join(rows):
    sets = []
    for _, t in rows:
        w = re.findall(GAP, (t or "").translate(LOW))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def joined(df):
    return sorted((tuple(r) for r in setjoin.join(df).collect()), key=str)


def test_join_equals_brute_force(docs):
    assert joined(docs) == slow_join([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_join_odd_rows(odd, none):
    assert joined(odd) == slow_join([(r.doc_id, r.text) for r in odd.collect()])
    assert setjoin.join(none).count() == 0


def test_join_of_crowds_chains_and_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    monkeypatch.setattr(setjoin, "QUERIES", 5)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10_000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(rng.randrange(3, 40))] + passage + [word() for _ in range(9)]) for _ in range(60)]
    for _ in range(120):  # a crowd whose members lie on both sides of 0.8
        own = base[:]
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(60)] = word()
        texts.append(" ".join(own))
    chain = [word() for _ in range(50)]
    for k in range(20):  # each is close to the next alone
        texts.append(" ".join(chain[2 * k :] + chain[: 2 * k][::-1]))
    texts += [texts[70]] * 30 + ["of of of", "OF of of", "if", "half of it if"]
    rng.shuffle(texts)
    rows = [(i % 230, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert joined(df) == slow_join(rows)


def test_rounds_lose_nothing(spark, monkeypatch):
    """Without any rounds the matrix alone finds all links."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(50)]
    rows = []
    for i in range(80):
        own = base[:]
        own[rng.randrange(50)] = f"x{i}"
        rows.append((i, " ".join(own[: rng.randrange(38, 51)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(setjoin, "first_links", lambda *_: spark.createDataFrame([], "a string, b string"))
    assert joined(df) == slow_join(rows)


def slow_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(GAP, t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                before = sum(1 for r in own if f in r[1]) - len(gone)
                left = [r for r in left if f not in r[1]]
                out[part, order, k + 1] = (len(left), len(gone), before, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
    total = Counter()
    for (part, order, k), x in out.items():
        total[part, order[k - 1]] += x[1]
    return {key: (*x, total[key[0], key[1][key[2] - 1]]) for key, x in out.items()}


def test_audit_equals_brute_force(spark, docs, odd, none, labels):
    told = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic")
    twice = labels.union(labels.withColumn("quality", F.lit(0)))
    for d, said in ((docs, told), (odd.union(odd.withColumn("doc_id", F.col("doc_id") + 100)), twice)):
        got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.digest(d, said).collect()}
        want = slow_audit([tuple(r) for r in d.select("doc_id", "text", "source").collect()], [tuple(r) for r in said.select("doc_id", "quality", "toxic").collect()])
        assert got == want
    assert audit.digest(none, labels).count() == 0


def test_long_lines_and_tokens_take_linear_time(spark):
    rng = random.Random(2)
    model = license.fit([])
    line = " ".join(rng.choice(["released under the MIT License", "some plain words here and there"]) for _ in range(30_000))
    began = time.perf_counter()
    assert model.scan(line) and time.perf_counter() - began < 10
    ratios = secrets.train(spark.createDataFrame([(1, "plain words alone")], "doc_id bigint, text string"))
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    blob, many = "".join(rng.choices(alphabet, k=1 << 20)), " ".join(rng.randbytes(15).hex() for _ in range(20_000))
    for text, base in ((blob, 0), (many, 20_000)):
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        began = time.perf_counter()
        assert secrets.scan(df, ratios=ratios).selectExpr("size(_base) AS n").first().n == base
        assert time.perf_counter() - began < 25


def test_samples_are_bounded_where_ids_repeat(spark):
    df = spark.range(3000).selectExpr("id % 2 AS doc_id", "concat('text number ', id) AS text", "CASE WHEN id % 3 = 0 THEN 'en' ELSE 'de' END AS lang")
    one = spark.range(900).selectExpr("7L AS doc_id", "concat('mot ', id % 5) AS text", "'fr' AS lang")
    rows = language.training_rows(df.union(one), each=20).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in rows} == {"en": 20, "de": 20, "fr": 5}
    assert sample_rows(df, 50, "text").count() == 50
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.sampled(df, labels, "quality", 40).count() == 40


def test_passages_of_a_few_documents_propose_no_pairs(spark, monkeypatch):
    """Texts that share a quarter with nine others aren't held against them, though their passages don't stand out from chance."""
    monkeypatch.setattr(setjoin, "COUNTERS", 1 << 12)
    rows = [(i, " ".join([*(f"own{i}x{k}" for k in range(90)), *(f"shared{i // 10}x{k}" for k in range(34))])) for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} end") for i in range(0, 300, 50)]
    pairs, plain = [], setjoin.candidates

    def counted(*args):
        out = plain(*args)
        pairs.append(out[0].count())
        return out

    monkeypatch.setattr(setjoin, "candidates", counted)
    got = {r.doc_id: r.component_id for r in setjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows} and pairs[0] < 300


def test_crowds_around_the_threshold_ask_groups_not_sets(spark, monkeypatch):
    """Near copies most of which lie just below 0.8 aren't held each against each."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(400):
        own = base[:]
        for k in rng.sample(range(150), 2 + i % 2):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
    asked, plain = [], setjoin.texts_of

    def counted(docs, wanted, repeated):
        if "asks" in wanted.columns:
            asked.append(wanted.where("asks").count())
        return plain(docs, wanted, repeated)

    monkeypatch.setattr(setjoin, "texts_of", counted)
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string")) == slow_join(rows)
    assert sum(asked) < 400 * 40
