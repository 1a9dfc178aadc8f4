import random
import re

import numpy as np
from llm_texts import prose

from folio.llm import nearjoin as N


def brute(rows):
    """(class_id, n_links, n_copies) of each row by comparing all pairs of texts."""
    texts, sets = {}, {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        key = tuple(w) if w else ("", t or "")
        texts.setdefault(key, []).append(N.NO_ID if i is None else i)
        k = min(5, len(w))
        sets[key] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    keys, root = list(sets), {k: k for k in sets}
    links = dict.fromkeys(keys, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[keys[a]] += 1
                links[keys[b]] += 1
                root[find(keys[a])] = find(keys[b])
    tops = {}
    for k in keys:
        tops.setdefault(find(k), []).extend(texts[k])
    known = lambda i: None if i == N.NO_ID else i
    return sorted([(known(i), known(min(tops[find(k)])), links[k], len(texts[k]) - 1) for k in keys for i in texts[k]], key=str)


def got(df):
    return sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in N.near_join(df).collect()], key=str)


def variants(seed, base, n, edits):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_odd_rows(make, odd_rows):
    assert got(make(odd_rows)) == brute(odd_rows)


def test_empty(make):
    assert got(make([])) == []
    assert N.keep_one(make([])).count() == 0


def test_groups_of_several_blocks(make, monkeypatch):
    # Blocks of 8: the group of 60 takes 36 units. Similarities lie around the threshold.
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = list(enumerate(variants(1, prose(9, 120), 60, 4) + variants(2, prose(10, 40), 10, 2) + [prose(100 + k, 30) for k in range(40)] + [prose(100, 30)] * 20))
    want, have = brute(rows), got(make(rows).repartition(6))
    assert [r[0] for r in have] == [r[0] for r in want]
    missed = sum(w[2] for w in want) - sum(h[2] for h in have)
    assert 0 <= missed <= 0.005 * sum(w[2] for w in want)
    assert missed or have == want


def test_blocks_go_on_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "BLOCK_BYTES", 100)
    r = random.Random(8)
    rows = [(n, n // 9, r.choice([0, 3, 9, 250])) for n in range(200)]
    blocks = {}
    for parts in (1, 5, 40):
        have = {x["node"]: x["block"] for x in N._blocks(spark.createDataFrame(rows, "node long, label long, chars long"), parts).collect()}
        assert blocks.setdefault("first", have) == have and len(have) == 200
    start, numbers = 0, []
    for n, _, chars in rows:
        numbers.append(n // 7 + start // 100)
        start += chars
    assert [blocks["first"][n] for n in range(200)] == numbers
    assert N._blocks(spark.createDataFrame([], "node long, label long, chars long"), 3).count() == 0


def test_keep_one(make):
    rows = [(5, prose(1, 50)), (3, prose(1, 50).upper()), (9, prose(2, 50)), (9, prose(2, 50)), (1, None), (2, "")]
    df = make(rows)
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (3, prose(1, 50).upper()), (9, prose(2, 50))]


def test_verification_is_exact():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40).astype("u8")) for _ in range(30)]
    met = N.linked(sets, np.arange(30), np.arange(30))
    for a in range(30):
        for b in range(30):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert met[a, b] == (5 * len(x & y) >= 4 * len(x | y))


def test_depth_shortens_until_the_target():
    assert N.fit_depth({}, 0.995) == (5, N.expected_recall(5))  # nothing sampled: the expectation at the threshold
    deep = {k * (N.DEPTH + 1) + N.DEPTH: 5 for k in range(400)}  # all links share whole runs
    assert N.fit_depth(deep, 0.998)[0] == N.DEPTH
    shallow = {k * (N.DEPTH + 1) + 3: 5 for k in range(400)}
    depth, recall = N.fit_depth(shallow, 0.998)
    assert depth == 3 and recall >= 0.998 and N.measured_recall(shallow)[4] < 0.998


def test_sampled_links_are_those_of_brute_force():
    texts = variants(4, prose(21, 60), 40, 3) + [prose(300 + k, 40) for k in range(20)]
    sample, words = N.build_sample(texts[:25]), {}
    words = N._Words()
    for t in texts:
        digest, found = N.shingles(t, words)
        runs = N.runs_of(found)
        want = []
        for k, other in enumerate(sample.digests):
            x = next(s for d, s in (N.shingles(o, words) for o in texts[:25]) if d == other)
            both = len(set(x.tolist()) & set(found.tolist()))
            if other != digest and 5 * both >= 4 * (len(x) + len(found) - both):
                shared = [int(next((i for i in range(N.DEPTH) if a[i] != b[i]), N.DEPTH)) for a, b in zip(N.runs_of(x), runs)]
                want.append(k * (N.DEPTH + 1) + max(shared))
        assert N.sampled_links(digest, found, runs, sample) == want


def test_neighbours_in_the_sorted_tries(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(3)
    rows = sorted((int(t), r.integers(0, 3, N.DEPTH).astype(">u4").tobytes()) for t in r.integers(0, 2, 300))
    for depth in (1, 3, 6):
        want = {i for i in range(1, 299) for j in (i - 1, i + 1) if rows[i][0] == rows[j][0] and rows[i][1][: 4 * depth] == rows[j][1][: 4 * depth]} | {0, 299}
        whole = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary()), pa.array(range(300), pa.int64()), pa.array([1] * 300, pa.int64())], ["tree", "run", "node", "chars"])
        for size in (1, 7, 300):
            got = [n for b in N._matched(iter([whole.slice(k, size) for k in range(0, 300, size)]), depth) for n in b.column("node").to_pylist()]
            assert got == sorted(want)


def test_results_do_not_depend_on_partitions(spark, make):
    rows = list(enumerate(variants(6, prose(31, 80), 50, 3) + [prose(400 + k, 30) for k in range(30)]))
    first = got(make(rows).repartition(2))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert got(make(rows).repartition(5)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repeated_rows_that_differ_elsewhere(spark):
    rows = [(7, prose(50, 30), "b"), (7, prose(50, 30), "a"), (9, prose(50, 30), "c")]
    kept = {tuple(N.keep_one(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()[0]) for x in (rows, rows[::-1])}
    assert len(kept) == 1 and kept.pop()[0] == 7


def test_recall_is_measured_over_all_texts(make, monkeypatch):
    # Texts of any length count: one pair here has over 20,000 characters a text.
    long = prose(40, 5000)
    texts = sorted({*variants(11, prose(9, 120), 40, 4), *variants(12, prose(10, 40), 12, 1), long, long + " end", *(prose(500 + k, 30) for k in range(30))})
    sets = [N.shingles(t, N._Words())[1] for t in texts]
    runs = [N.runs_of(x) for x in sets]
    stand = {}
    for a in range(len(texts)):
        for b in range(len(texts)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if a != b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and N.common_prefix(runs[a], runs[b]).max() == N.DEPTH:
                s = both / (len(sets[a]) + len(sets[b]) - both)
                p = np.array([N.expected_recall(d, s) for d in range(N.DEPTH + 1)])
                stand[a] = stand.get(a, 0) + p / p[N.DEPTH]
    want = np.min([x / x[0] for x in stand.values()], axis=0)
    measured, real = [], N._measured
    monkeypatch.setattr(N, "_measured", lambda df: measured.append(real(df)) or measured[-1])
    monkeypatch.setattr(N, "BLOCK", 8)
    got(make(list(enumerate(texts))).repartition(5))
    assert texts.index(long) in stand and np.allclose(measured[0], want, atol=1e-6)


def test_the_prefix_shortens_by_what_all_links_say(make, monkeypatch):
    depths, real = [], N._round
    monkeypatch.setattr(N, "_round", lambda *a: depths.append(a[-1]) or real(*a))
    alike = list(enumerate(variants(13, prose(60, 300), 110, 2)))
    assert got(make(alike)) == brute(alike) and depths == [N.DEPTH]
    depths.clear()
    apart = [(k, t) for k in range(40) for t in (prose(700 + k, 49), " ".join(prose(700 + k, 49).split(" ")[:-9] + ["x"] * 4))]
    got(make(list(enumerate(t for _, t in apart))))
    assert depths == [N.DEPTH, N.DEPTH - 1]


def test_components(spark):
    from folio.llm.common import components

    r = random.Random(2)
    edges = [(r.randrange(500), r.randrange(500)) for _ in range(330)] + [(0, k) for k in range(600, 700)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    have = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert have == {x: find(x) for x in touched}
