import random
import tracemalloc

import pyarrow as pa

from folio.llm import lines


def brute(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = lines.line_key(x)
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(lines.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        own, kept = (t or "").split("\n"), []
        for x in own:
            h = holders.get(lines.line_key(x), set())
            if len(h) < min_docs or (lines.NO_ID if i is None else i) == max(h):
                kept.append(x)
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(df, rows, **options):
    got = lines.dedup_lines(df, **options).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got], key=str) == brute(rows, **options)


def test_odd_rows(make, odd_rows):
    check(make(odd_rows), odd_rows)


def test_empty(make):
    assert lines.dedup_lines(make([])).count() == 0


def test_keys_and_edges(make):
    # Few distinct lines over many partitions: most keys touch an edge, one is half of all lines.
    r = random.Random(5)
    pool = [f"{k:03d} " + "Ünd line of text " * 3 for k in range(12)]
    rows = []
    for i in range(400):
        own = [pool[0] if r.random() < 0.5 else r.choice(pool) for _ in range(r.randrange(6))]
        rows.append((r.choice([i, i, i - 1, None]), "\n".join(r.choice([x, x.upper() if r.random() < 0.2 else x, " " + x + "\t\r"]) for x in own)))
    check(make(rows).repartition(5), rows)
    check(make(rows), rows, min_chars=10, min_docs=2)


def test_bitmap_round_trip(make):
    text = "\n".join("x" * 50 if k % 3 else f"line {k} " * 9 for k in range(40))
    rows = [(i, text) for i in range(6)]
    maps = {r.doc: r.bitmap for r in lines.keep_bitmaps(make(rows)).collect()}
    assert set(maps) == {0, 1, 2, 3, 4}
    assert lines.apply_bitmap(text, maps[0]) == (40, [])
    assert lines.apply_bitmap("a\nb", None) == (2, ["a", "b"])


def most_mb(parts):
    """Python's and numpy's largest memory while the parts pass by."""
    tracemalloc.start()
    try:
        for _ in parts:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_large_batches():
    # A batch of 16 MB of text, and one of a million lines to drop: neither is taken up as a whole.
    n, text = 200, "\n".join(f"{k:05d} " + "x" * 73 for k in range(1000))
    bitmap = next(lines._to_bitmap(iter([pa.record_batch({"doc": [0], "mark": [0], "at": [[0, 7, 999]]})]))).column("bitmap")[0].as_py()
    batch = pa.record_batch({"doc": range(n), "mark": range(n), "text": [text] * n, "bitmap": [bitmap] * n})
    assert most_mb(lines._hash_lines(iter([batch]), 40)) < 8
    assert most_mb(lines._apply(iter([batch]))) < 8
    at = pa.array([range(k, 100_000, 2) for k in range(20)], pa.list_(pa.int32()))
    assert most_mb(lines._to_bitmap(iter([pa.record_batch({"doc": range(20), "mark": range(20), "at": at})]))) < 8


def test_parts_of_batches():
    # Parts, and lists that begin within a batch's values, give what whole batches give.
    batch = pa.record_batch({"doc": range(600), "mark": range(600), "text": [f"{k} " * 30 + "\nshort\n" + "y" * 50 for k in range(600)], "bitmap": [None] * 600})
    got = pa.Table.from_batches(lines._hash_lines(iter([batch]), 40)).to_pydict()
    assert (got["doc"], got["mark"], got["pos"]) == ([k for k in range(600) for _ in "ab"],) * 2 + ([0, 2] * 600,)
    done = pa.Table.from_batches(lines._apply(iter([batch]))).to_pydict()
    assert (done["doc"], done["kept_text"], set(done["n_dropped"])) == (list(range(600)), batch.column("text").to_pylist(), {0})
    lists = pa.record_batch({"doc": [1, 2, 3], "mark": [1, 2, 3], "at": pa.array([[3], [0, 9], [1]], pa.list_(pa.int32()))}).slice(1)
    maps = next(lines._to_bitmap(iter([lists]))).column("bitmap").to_pylist()
    assert [lines.apply_bitmap("\n".join("abcdefghij"), m)[1] for m in maps] == [list("bcdefghi"), list("acdefghij")]


def test_texts_are_not_sorted(make):
    rows = [(i, "z" * 60) for i in range(9)]
    df = lines.dedup_lines(make(rows))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    check(make(rows), rows)
