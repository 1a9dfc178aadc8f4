import hashlib
import random

from folio.llm import exact
from folio.llm.common import SPACES


def brute(rows):
    groups = {}
    for i, t in rows:
        bare = "".join(c for c in t or "" if c not in SPACES)
        groups.setdefault(bare, []).append((-len(t or ""), i is None, i or 0, i))
    return {bare: (min(g)[3], len(g)) for bare, g in groups.items()}


def check(df, rows):
    want = brute(rows)
    got = exact.dedup(df).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(b.encode()).hexdigest(): v for b, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
    for digest in by_hash:
        kept = [r for r in got if r.text_sha256 == digest and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == by_hash[digest][0]


def test_odd_rows(make, odd_rows):
    check(make(odd_rows), odd_rows)


def test_random_groups_with_a_hot_one(make):
    r = random.Random(3)
    rows = [(i, ("hot copy" if r.random() < 0.4 else f"t{r.randrange(300)}") + " " * r.randrange(4)) for i in range(3000)]
    check(make(rows).repartition(7), rows)


def test_empty(make):
    assert exact.dedup(make([])).count() == 0
    assert exact.keep_first(make([])).count() == 0


def test_keep_first_keeps_rows_as_they_are(make, odd_rows):
    df = make(odd_rows)
    kept = exact.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 4, 6, 7, 8], key=str)


def test_of_repeated_ids_the_longest_stays(make):
    kept = exact.keep_first(make([(1, "a b"), (1, "a  b"), (2, "ab")])).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(1, "a  b")]
