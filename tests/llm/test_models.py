from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from quillgrid.llm import decontaminate, language, quality, toxicity


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeat = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def test_counts_equal_brute_force(docs):
    texts = [r.text for r in docs.select("text").collect()] + [None, "", " \n", "a b c d e a b c d e", "x\nx\n\n\x1cy\x85z é𠀀|"]
    for t in texts:
        assert quality.measure(t)[0] == slow_counts(t)


def test_trees_are_monotonic_and_flat_scoring_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) - x[:, 2] > 0.4).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0) == (y > 0)).mean() > 0.95
    for j, f in enumerate(quality.FEATURES):
        sign = (f in quality.RISING) - (f in quality.FALLING)
        if sign:
            for row in x[:20]:
                grid = np.repeat(row[None], 30, axis=0)
                grid[:, j] = np.linspace(0, 1, 30)
                assert (sign * np.diff(m.score(grid)) >= -1e-9).all()

    def walk(t, row):
        node = 0
        while node < m.feature.shape[1]:
            node = 2 * node + 1 + int(row[m.feature[t, node]] > m.threshold[t, node])
        return m.leaf[t, node - m.feature.shape[1]]

    slow = [m.start + sum(walk(t, row) for t in range(len(m.leaf))) for row in x[:50]]
    assert np.allclose(m.score(x[:50]), slow)


def test_quality_columns_equal_brute_force(spark, docs, labels):
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = {r.doc_id: r for r in quality.digest(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()}
    for r in docs.select("doc_id", "text").collect():
        counts, got = slow_counts(r.text), rows[r.doc_id]
        assert tuple(got[c] for c in quality.COUNTS) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        score = 1 / (1 + np.exp(-model.score(np.array([quality.measure(r.text)[1]]))[0])) if model else 1.0
        assert got.base_failed == failed and got.kept == (not failed and score >= 0.5) and abs(got.score - score) < 1e-9


def test_verdicts_on_rows_that_the_trees_have_not_seen(spark):
    big, real = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = quality.train(big, real.where(~held))
    rows = quality.judge(big.select("doc_id", "text").join(real.where(held), "doc_id"), model).select("quality", "__q.*").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert len(bad) > 50 and sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_quality_query(spark, docs, odd, none, labels):
    real = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.digest(big, real).join(real, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    by = {r.doc_id: r for r in quality.digest(odd, labels).collect()}
    assert by[0].base_failed and not by[0].kept and by[0].n_words == 0 and by[3].base_failed
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.digest(none, labels).count() == 0 and quality.digest(odd, labels.where("false")).count() == odd.count()


def test_language_on_held_out(spark, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.digest(big).join(big.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in language.digest(odd).collect()}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == "und" and by[0].score == 0
    assert language.digest(none).count() == 0
    taught = language.training_rows(big)
    assert taught.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).count() == 0
    assert max(r["count"] for r in taught.groupBy("lang").count().collect()) <= language.SAMPLE_EACH
    model, wanted = language.train(big), {r.doc_id: r for r in rows}
    for r in big.select("doc_id", "text").collect():
        name, score = slow_language(model, r.text) if language.has_letter(r.text) else ("und", 0.0)
        assert wanted[r.doc_id].lang_pred == name and abs(wanted[r.doc_id].score - score) < 2e-4


def slow_language(model, text):
    """Family by the largest margin, then one vote for each pair of its languages."""
    x = np.append(language.histogram(text), np.float32(1))
    margins = [float(w @ x) for w in model.family_weights]
    family = margins.index(max(margins))
    own = model.languages[model.families[family]]
    soft = lambda values, at: 1 / sum(np.exp(language.SLOPE * (v - values[at])) for v in values)
    score = soft(margins, family) if len(margins) > 1 else 1.0
    if len(own) == 1:
        return own[0], score
    votes, sums = [0] * len(own), [0.0] * len(own)
    for (i, j), w in zip(model.pairs[model.families[family]], model.pair_weights[model.families[family]], strict=True):
        m = float(w @ x)
        votes[i if m >= 0 else j] += 1
        sums[i] += m
        sums[j] -= m
    best = max(range(len(own)), key=lambda i: (votes[i], sums[i]))
    return own[best], score * soft([s / (len(own) - 1) for s in sums], best)


def test_texts_without_a_letter_are_und_and_no_language_is_left_out(spark):
    texts = ["²", "½ ① 12", "ª", "一", "ab", "٣", "_"]
    langs = [(f"{chr(97 + i // 26)}{chr(97 + i % 26)}", f"w{i} " * 5 + f"{chr(97 + i // 26) * 5}{chr(97 + i % 26) * 5}") for i in range(230)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(100 + 5 * i + k, t, s) for i, (s, t) in enumerate(langs) for k in range(5)], "doc_id bigint, text string, lang string")
    assert {r.lang for r in language.training_rows(df).select("lang").distinct().collect()} == {s for s, _ in langs}
    model = language.Model(["only aa"], np.zeros((1, language.SIZE + 1), dtype=np.float32), {"only aa": ["aa"]}, {"only aa": []}, {"only aa": np.zeros((0, language.SIZE + 1), dtype=np.float32)})
    got = {r.doc_id: r.lang_pred for r in language.identify(df.where("doc_id < 100"), model).collect()}
    assert [got[i] for i in range(len(texts))] == ["und", "und", "aa", "aa", "aa", "und", "und"]


def test_toxicity_on_held_out(spark, odd, none, labels):
    d = "/root/testdata/sf0.1"
    big, real = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = [r for r in toxicity.digest(big, real).join(real, "doc_id").collect() if r.held_out]
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.digest(odd, labels).count() == odd.count() and toxicity.digest(none, labels).count() == 0
    assert {r.score_input for r in toxicity.rate(odd, toxicity.train(odd, labels)).collect()} == {"y"}


def test_scores_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(60, rng.integers(1, 20), replace=False)).astype(np.int32) for _ in range(400)]
    m = toxicity.fit(rows, np.array([float(3 in r or 5 in r and 7 in r) for r in rows]))
    assert m.used.any()
    for r in [*rows[:50], rows[0][:0]]:
        raw = m.bias + sum(float(m.weights[i]) for i in r) + sum(float(m.factors[i].astype(float) @ m.factors[j].astype(float)) for k, i in enumerate(r) for j in r[:k])
        assert abs(m.score(r) - 1 / (1 + np.exp(-raw))) < 1e-6
    assert np.allclose(m.scores(rows), [m.score(r) for r in rows])


def test_two_words_that_tell_nothing_alone_tell_by_their_pair():
    a, b = toxicity.terms("alpha"), toxicity.terms("beta")
    filler = [toxicity.terms(f"w{i}") for i in range(30)]
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1200):
        p, q = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.unique(np.concatenate([filler[rng.integers(30)], *([a] if p else []), *([b] if q else [])])))
        y.append(float(p != q))
    m, linear = toxicity.fit(rows, np.array(y)), toxicity.fit(rows, np.array(y), pairs=False)
    cases = [(a, 1), (b, 1), (np.union1d(a, b), 0), (a[:0], 0)]
    assert all((m.score(x) > 0.5) == wanted for x, wanted in cases)
    right = [np.mean([(v > 0.5) == w for v, w in zip(k.scores(rows), y, strict=True)]) for k in (m, linear)]
    assert right[0] > 0.98 and right[1] < 0.7


def test_factorization_learns_pairs_that_single_terms_miss():
    a, b = toxicity.terms("alpha"), toxicity.terms("beta")
    filler = [toxicity.terms(f"w{i}") for i in range(30)]
    rng = np.random.default_rng(2)
    rows, y = [], []
    for i in range(1200):
        p, q = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.unique(np.concatenate([filler[rng.integers(30)], *([a] if p else []), *([b] if q else [])])))
        y.append(float(p and q))
    m = toxicity.fit(rows, np.array(y))
    pair = float(m.factors[a[0]] @ m.factors[b[0]])
    assert m.score(np.union1d(a, b)) > 0.5 > max(m.score(a), m.score(b)) and pair > 0


def slow_similarity(x, y):
    def bag(words):
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])

    a, b = bag(x), bag(y)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def slow_matches(texts, items, least=0.8):
    out = {}
    for i, t in texts:
        words = (t or "").lower().split()
        for k, s in items:
            item = s.lower().split()
            for first in range(-len(item) + 1, len(words)):
                own = words[max(0, first) : first + len(item)]
                if own and (s := slow_similarity(own, item)) >= least and s > out.get((i, k), 0):
                    out[i, k] = s
    return out


def test_leaks_equal_brute_force(spark):
    item = [f"t{i}" for i in range(50)]
    odd_word = [*item[:25], "new", *item[25:]]
    texts = [(1, " ".join(["x"] * 30 + item + ["y"] * 30)), (2, " ".join(item[3:])), (3, " ".join(["z", *odd_word, "z"])), (4, " ".join(item[:20])), (5, " ".join(w.upper() for w in item)), (6, None), (7, ""), (8, "k1 k2 k3"), (9, "a k1 k2 k3 b"), (10, " ".join(["t1"] * 200)), (11, " ".join(item[::-1]))]
    items = [(100, " ".join(item)), (101, "k1 k2 k3"), (102, " ".join(["t1"] * 12)), (103, "")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(df, bench).collect()}
    assert found == slow_matches(texts, [x for x in items if x[1]])
    clean = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert clean == {i for i, _ in texts} - {i for i, _ in found}


def test_leaks_odd_rows(spark, odd, none):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert decontaminate.matches(odd, bench).count() == 0 and decontaminate.matches(none, bench).count() == 0
    assert decontaminate.matches(odd, bench.where("false")).count() == 0
    assert decontaminate.clean(odd, bench).count() == odd.count()


def test_rows_without_an_id_or_with_one_id_are_judged_alone(spark):
    item = " ".join(f"t{i}" for i in range(50))
    other = " ".join(f"u{i}" for i in range(60))
    rows = [(None, item), (None, other), (5, f"x {item} y"), (5, other), (5, other), (6, None)]
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id bigint, text string, _doc string, key int")
    bench = spark.createDataFrame([(100, item)], "item_id bigint, text string")
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in df.collect() if r.text is None or "t1 " not in r.text)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()} == {(None, 100), (5, 100)}


def test_many_windows_of_a_row_and_of_a_table(spark, monkeypatch):
    item = [f"t{i}" for i in range(30)]
    texts = [(1, " ".join(item * 40)), (2, " ".join(["x", *item[2:], "y"] * 30)), (3, " ".join(item[:9] * 50))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame([(100, " ".join(item)), (101, " ".join(item[:12]))], "item_id bigint, text string")
    wanted = slow_matches(texts, [(r.item_id, r.text) for r in bench.collect()])
    for few in (decontaminate.FEW_WINDOWS, 0):
        monkeypatch.setattr(decontaminate, "FEW_WINDOWS", few)
        monkeypatch.setattr(decontaminate, "NEAR_WORDS", 64)
        assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(df, bench).collect()} == wanted
