import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 1000])
def test_jump_shards(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 1300), *(k * -77777777777 for k in range(100))]
    rows = sharding.jump_shards(spark.createDataFrame([(k,) for k in keys], "k bigint"), F.col("k"), shards).collect()
    assert all((r["shard"], r["grown_shard"]) == (jump(r["k"], shards), jump(r["k"], shards + 1)) for r in rows)


def test_sharded_documents(docs):
    rows = sharding.shard_documents(docs, 24).collect()
    assert len(rows) == docs.count()
    text = dict(docs.select("doc_id", "text").collect())
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.shard, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), jump(r.doc_id, 24), jump(r.doc_id, 25))
    for shard in {r.shard for r in rows}:
        own = sorted((r.slot, r.doc_id) for r in rows if r.shard == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_null_keys_and_empty_tables(spark, empty):
    rows = sharding.shard_documents(spark.createDataFrame([(None, "a"), (None, None)], "doc_id bigint, text string")).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == [0, 1]
    assert sharding.shard_documents(empty).collect() == []
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert mixing.take_mix(empty).collect() == []


@pytest.mark.parametrize("n,span", [(0, 60), (1, 60), (2, 64), (3000, 58), (3000, 20)])
def test_golomb_round_trip(n, span):
    values = np.sort(np.random.default_rng(n).integers(0, 2 ** min(span, 63), n, dtype=np.uint64))
    shift = exact_dedup._shift(n, span)
    coded = exact_dedup.golomb_encode(values, shift)
    assert (exact_dedup.golomb_decode(coded, n, shift) == values).all()
    if n > 1000 and span > 40:
        assert len(coded) * 8 < n * (span - np.log2(n) + 2.5)


def test_exact_duplicates(docs):
    rows = exact_dedup.exact_duplicates(docs).collect()
    given = [(i, t or "") for i, t in docs.select("doc_id", "text").collect()]
    sizes, keep = Counter(t for _, t in given), {}
    for i, t in given:
        keep[t] = max(keep.get(t, i), i)
    text = dict(given)
    assert len(rows) == len(given)
    for r in rows:
        t = text[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep[t], sizes[t], keep[t] == r.doc_id, hashlib.sha256(t.encode()).hexdigest())
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(keep.values())


def test_one_text_in_most_rows(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text").repartition(5)
    rows = exact_dedup.exact_duplicates(docs)
    assert rows.where("kept").count() == 2001
    assert {r.keep_id for r in rows.where("group_size > 1").collect()} == {2997}


def brute_mix(rows, weights=(5, 2, 1), most=3):
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
            open_.discard(s)
    return sizes, target


def check_mix(docs):
    import re

    rows = mixing.take_mix(docs).collect()
    given = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    sizes, target = brute_mix(given)
    assert sorted((r.doc_id, r["size"]) for r in rows) == sorted((i, n) for i, _, n in given)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= len(sizes) + 1 for s in sizes)
    assert sum(taken.values()) == sum(sizes.values())
    return rows


def test_mix(docs):
    first, again = check_mix(docs), mixing.take_mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, (r.asDict().values() for r in first)), key=str) == sorted(map(tuple, (r.asDict().values() for r in again)), key=str)
    mixed = mixing.mixed_documents(docs.dropDuplicates(["doc_id"]))
    assert mixed.columns == docs.columns
    used = {r.doc_id: r.copies for r in mixing.take_mix(docs.dropDuplicates(["doc_id"])).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == used


def test_mix_with_a_small_heavy_source(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "if(id < 5, 'a', if(id < 300, 'b', null)) as source", "repeat('w ', cast(1 + id % 7 as int)) as text")
    check_mix(docs)


def test_a_copy_leaves_other_texts_of_its_doc_id(spark):
    from tessera.llm.exact_dedup import drop_exact_duplicates

    rows = [(1, "copy"), (1, "alone"), (2, "copy"), (3, None), (4, ""), (None, "copy"), (None, "own")]
    left = drop_exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert left.columns == ["doc_id", "text"]
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, "alone"), (2, "copy"), (4, ""), (None, "own")], key=str)


def test_rows_and_not_ids_are_dropped(spark):
    """A doc_id may stand on several rows: no text is lost, and of whole twins one stays."""
    rows = [(1, "a", "p"), (5, "a", "q"), (1, "b", "r"), (7, "t", "s"), (7, "t", "s"), (8, None, "u"), (8, "", "v"), (None, "n", "w"), (None, "n", "w"), (9, "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __row string").repartition(3)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert len(got) == 5 and got[:2] == [(1, "b"), (5, "a")] and (9, "t") in got and (None, "n") in got and {i for i, t in got if not t} == {8}
    many = spark.range(4000).selectExpr("7L as doc_id", "if(id % 2 = 0, 'twin', concat('other', id)) as text").repartition(5)
    assert exact_dedup.drop_exact_duplicates(many).count() == 2001


@pytest.mark.parametrize("n,shift", [(0, 0), (0, 9), (1, 0), (1, 40), (1000, 3), (1000, 12)])
def test_golomb_round_trip(n, shift):
    values = np.sort(np.random.default_rng(n).integers(0, 1 << 14, n, dtype=np.uint64))
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, shift), n, shift) == values).all()


def test_columns_of_any_name_pass_sharding(spark):
    df = spark.createDataFrame([(1, "k", 2.5, "j")], "doc_id bigint, _key string, _jump double, __key___ string")
    (row,) = sharding.jump_shards(df, F.col("doc_id"), 24).collect()
    assert (row._key, row._jump, row["__key___"], row.shard) == ("k", 2.5, "j", jump(1, 24))


def test_mixing_keeps_columns_of_any_name(docs):
    named = docs.select("doc_id", "text", "source", F.lit(1).alias("__copies"), F.lit(2).alias("__id"), F.lit(3).alias("__copy"), F.lit(4).alias("__row"))
    rows = mixing.mixed_documents(named)
    assert rows.columns == named.columns and {tuple(r)[3:] for r in rows.collect()} == {(1, 2, 3, 4)}


def test_mixed_rows_hold_the_words_that_the_mix_takes(spark):
    import re

    docs = spark.range(300).selectExpr("id as doc_id", "if(id < 7, 'a', if(id < 200, 'b', null)) as source", "concat('  ', repeat('w\\t x', cast(1 + id % 50 as int)), ' end ') as text", "'k' as other")
    taken = {r.doc_id: r.taken for r in mixing.take_mix(docs).collect() if r.taken}
    text = {r.doc_id: r.text for r in docs.collect()}
    held, whole = Counter(), 0
    for r in mixing.mixed_documents(docs).collect():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        held[r.doc_id] += words
        whole += r.text == text[r.doc_id]
        assert words and text[r.doc_id].startswith(r.text) and r.other == "k"
    assert held == taken and whole > 100


def test_first_words_keep_white_space(spark):
    long = "lorem \n" * 20000
    rows = [(" a  b\n\nc d ", 3), ("a", 1), (long, 15000)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string, n int").select(mixing.first_words(F.col("text"), F.col("n"))).collect()]
    assert got == [" a  b\n\nc", "a", ("lorem \n" * 15000)[:-2]]
