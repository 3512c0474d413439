import random

import numpy as np
import xxhash

from quillgrid.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_sets(texts):
    split = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]


def slow_components(fps, sets=None):
    """{row: smallest row reachable} by all pairs: 2 bits apart, or sets that share 0.8."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= 2
            if near or sets and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_digest_equals_brute_force(docs):
    rows = {r.doc_id: r for r in simhash.digest(docs).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [slow_fingerprint(t) for _, t in texts]
    assert all(rows[i].fingerprint == f"{f:016x}" for (i, _), f in zip(texts, fps, strict=True))
    assert all(rows[i].component_id == texts[c][0] for (i, _), c in zip(texts, slow_components(fps), strict=True))


def test_chains_and_crowded_points(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)} | {base}
    chain = rng.getrandbits(64)
    for i in range(0, 60, 2):
        fps.add(chain)
        chain ^= 3 << i
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    groups = {}
    for r in simhash.components(simhash.links(df)).collect():
        groups.setdefault(r.root, set()).add(r.node)
    wanted = {}
    for i, c in enumerate(slow_components(fps)):
        wanted.setdefault(c, set()).add(signed[i])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for x in wanted.values() if len(x) > 1)


def test_forest_by_lookup_equals_forest_by_scan(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    scan = simhash._forest(fps)
    monkeypatch.setattr(simhash, "SCAN", 0)
    look = simhash._forest(fps)
    assert len(scan) == len(look) and {x for p in scan for x in p} == {x for p in look for x in p}


def test_odd_rows(odd, none):
    rows = simhash.digest(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {0, 1, 2} and {r.component_id for r in zero} == {0}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.digest(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 3, 4, 6, 7, 8, 9, 10]


def test_rows_without_an_id_or_with_one_id_stay_apart(spark):
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (9, texts[2]), (9, texts[3]), (9, texts[2]), (None, texts[2]), (1, texts[4]), (1, texts[3]), (2, texts[4]), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.one_of_each(df).collect()), key=str)
    assert kept == sorted([(True, 0, texts[0]), (True, 0, texts[1]), (False, 9, texts[2]), (False, 1, texts[3]), (False, 1, texts[4]), (False, 7, "")], key=str)


def test_edited_copies_leave_with_their_group(spark):
    rng = random.Random(8)
    texts = []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for _ in range(k % 4):
            copy = list(words)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(200)] = "edited"
            texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    roots = slow_components([slow_fingerprint(t) for t in texts], slow_sets(texts))
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {i for i, c in enumerate(roots) if c == i}


def test_lookup_finds_links_in_the_order_of_spark(monkeypatch):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(1)
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(1 << 63 | 1), fps ^ np.uint64(1 << 17)]))
    fps = np.sort(fps.view(np.int64)).view(np.uint64)
    scan = simhash._forest(fps)
    monkeypatch.setattr(simhash, "SCAN", 0)
    look = simhash._forest(fps)
    assert len(scan) == len(look) == 800 and {x for p in scan for x in p} == {x for p in look for x in p} == set(range(1200))


def test_copies_among_texts_that_share_a_long_passage(spark):
    rng = random.Random(5)
    passage = [f"p{rng.randrange(5000)}" for _ in range(175)]
    texts = []
    for _ in range(100):
        words = passage + [f"w{rng.randrange(5000)}" for _ in range(25)]
        texts.append(" ".join(words))
        for at in (179, 184, 189, 194):
            words[at] = f"edited{rng.randrange(1000)}"
        texts.append(" ".join(words))
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    roots = slow_components([slow_fingerprint(t) for t in texts], slow_sets(texts))
    assert 1 < len(set(roots)) < len(texts)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {i for i, c in enumerate(roots) if c == i}


def test_forest_of_a_crowded_band_connects_as_all_pairs(spark):
    rng = random.Random(6)
    sets = []
    for k in range(80):
        if k % 4 == 0:
            base = rng.sample(range(70, 600), 30)
        sets.append(set(range(70)) | set(base[rng.randrange(13) :]) | set(rng.sample(range(600, 900), rng.randrange(13))))
    codes = np.array([x for s in sets for x in s])
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links = simhash._similar_forest(codes, starts, np.arange(80), np.zeros((80, 4), dtype=np.uint64))
    fps = [rng.getrandbits(64) for _ in sets]
    roots = slow_components(fps, sets)
    assert 1 < len(set(roots)) < 80 and len(links) == 80 - len(set(roots))
    assert all(roots[a] == roots[b] for a, b in links)
