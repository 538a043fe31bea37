import re
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import near_dedup as N
from tessera.llm.components import components


def brute(rows, width, percent):
    """doc_id to (set size, least doc_id linked)."""
    sets = {}
    for i, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = set(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, width=2, percent=80):
    rows = N.near_duplicates(df, width, percent).collect()
    want = brute(df.select("doc_id", "text").collect(), width, percent)
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(docs, width):
    check(docs, width)


def test_a_large_group_with_stragglers(spark):
    """Copies of one text with some words changed: many pairs on both sides of the threshold."""
    rng = np.random.default_rng(4)
    base, rows = [f"w{k}" for k in range(80)], []
    for i in range(150):
        words = list(base)
        for j in rng.choice(80, rng.integers(1, 9), replace=False):
            words[j] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))


def test_blocks_cover_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 2000)
    test_a_large_group_with_stragglers(spark)


def test_chains_reach_far(spark):
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_exact_copies_of_most_rows(spark):
    docs = spark.range(1200).selectExpr("id as doc_id", "if(id % 2 = 0, 'the same few words again', concat('other', id, ' text', id)) as text").repartition(4)
    rows = N.near_duplicates(docs, 2, 80)
    assert rows.where("kept").count() == 601


def test_empty_table_and_words_without_pairs(spark, empty):
    assert N.near_duplicates(empty).collect() == []
    check(spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, None), (5, " ")], "doc_id bigint, text string"))


def test_drop_keeps_columns(docs):
    left = N.drop_near_duplicates(docs, 2, 80)
    want = brute(docs.select("doc_id", "text").collect(), 2, 80)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_rows_and_not_ids_are_dropped(spark):
    words = [f"w{k}" for k in range(40)]
    x, y, z = (" ".join(w) for w in (words, reversed(words), words[::2]))
    rows = [(1, x), (5, x), (5, y), (7, z), (7, z), (8, y + " w"), (9, None), (9, None), (3, x.upper()), (1, x)]
    left = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 5, 80).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == sorted([(1, x), (5, y), (7, z), (9, ""), (9, "")])
    # Two texts of one doc_id that are near copies of each other: one stays.
    twins = [(1, x), (1, x + " end"), (2, y)]
    left = N.drop_near_duplicates(spark.createDataFrame(twins, "doc_id bigint, text string"), 5, 80).collect()
    assert sorted(r.doc_id for r in left) == [1, 2]


def test_a_large_mixed_bucket_is_written_about_once(spark):
    """A hundred thousand members of one component and three others: no replication by the number of blocks."""
    members = spark.range(100_003).selectExpr("1L as key", "id as node", "if(id < 100000, 0L, id) as label", "300L as n")
    dealt = N.dealt_members(members, lambda rows, buckets: rows.join(buckets, "key")).cache()
    blocks = -(-100_000 * (300 + N.MEMBER) // N.BLOCK)
    assert blocks > 100 and dealt.count() == 100_000 + 3 * (blocks + 1)
    met = dealt.where("node >= 100000").groupBy("x", "y").count()
    assert met.count() == blocks + 1 and dealt.groupBy("x", "y").count().agg({"count": "max"}).head()[0] < 3 * N.BLOCK // N.MEMBER


def test_dealt_members_of_other_components_all_meet(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 2000)
    members = spark.range(120).selectExpr("id % 2 as key", "id as node", "case when id < 70 then 0L when id < 80 then 70L else id end as label", "id as n")
    rows = N.dealt_members(members, lambda rows, buckets: rows.join(buckets, "key")).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.key, r.x, r.y), []).append(r)
    met = {(a.node, b.node) for g in groups.values() for a in g for b in g if a.label != b.label and (a.x == a.y or a.block != b.block)}
    label = {r.node: (r.key, r.label) for r in rows}
    assert met == {(a, b) for a in label for b in label if label[a][0] == label[b][0] and label[a][1] != label[b][1]}


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.8, 0.95):
        found = []
        for _ in range(60):
            n = 300
            c = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 2**64, 2 * n - c, dtype=np.uint64)
            a, b = (np.frombuffer(N.signature(N.minima(x)), "<u8") for x in (pool[:n], pool[n - c :]))
            found.append(N.similarity(N.equal_minima(a, b)))
        assert np.mean(found) == pytest.approx(j, abs=0.02)


def test_components(spark):
    pairs = [(1, 2), (3, 2), (10, 11), (12, 11), (12, 20), (5, 5), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 20: 10, **{k: 30 for k in range(30, 36)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
