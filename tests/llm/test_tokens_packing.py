import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, tokens
from tessera.llm.common import scratch_path


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_are_what_the_library_gives(name, lower, texts):
    rng = np.random.default_rng(5)
    letters = list("ab Cé\n\t .,'s1 ́ΣİKſ\x85\x0b\x1c　!<|>")
    odd = ["".join(rng.choice(letters, rng.integers(1, 25))) for _ in range(3000)]
    marked = ["a <|endoftext|> b", "see <|endoftext|>", "<|startoftext|>x<|EndOfText|> y", "a <| b\n<|endoftext", "<|endoftext|><|endoftext|>\n\n"]
    every = [t or "" for _, t in texts] + odd + marked + [f"{a} {m}{b}" for m in marked for a, b in (("word", ""), ("é ", "\tz"))]
    own = tokens.PieceEncoder(public_tokenizers.path(name), lower)
    encode = plain(name)
    for text, got in zip(every, own.encode(every), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == encode(text), repr(text)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 10)
    monkeypatch.setattr(tokens, "MOST_CORE", 4)
    own = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), True)
    encode = plain("word_bpe_49k.json")
    for k in range(30):
        text = " ".join(f"w{(k * 3 + j) % 25}x" for j in range(12))
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == encode(text)
        assert len(own.pieces) <= 10 + 1 and len(own.pieces.core) <= 4


def test_token_store_round_trip(spark, docs):
    encode = plain("byte_bpe_50k.json")
    got = sorted(tokens.token_store(docs, public_tokenizers.path("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    rows = sorted(docs.select("doc_id", "text").collect())
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    at, by_id = 0, dict(rows)
    for r in got:
        ids = encode(by_id[r.doc_id]) + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_store_selective_reads(spark, docs):
    path = scratch_path(spark, "store")
    tokens.write_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path, public_tokenizers.path("byte_bpe_50k.json"))
    some = tokens.read_tokens(spark, path, 5, 9).orderBy("doc_id").collect()
    encode, by_id = plain("byte_bpe_50k.json"), dict(docs.select("doc_id", "text").collect())
    assert [r.doc_id for r in some] == [5, 6, 7, 8, 9]
    assert all(list(r.ids) == encode(by_id[r.doc_id]) + [0] for r in some)
    meta = {r.doc_id: r.start for r in tokens.read_metadata(spark, path).collect()}
    assert all(meta[r.doc_id] == r.start for r in some)
    plan = tokens.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan


def test_ordered_input_is_not_shuffled(spark):
    ordered = spark.range(0, 100, 1, 4).selectExpr("id as doc_id", "'t' as text")
    assert tokens.in_order(ordered.select("doc_id"))
    assert not tokens.in_order(ordered.repartition(3).select("doc_id"))
    assert not tokens.in_order(spark.createDataFrame([(1,), (None,)], "doc_id bigint").repartition(2))


def test_input_in_hash_partitions_is_written_in_order(spark):
    """An adaptive exchange may coalesce a plan of ids alone to one partition, and that of whole rows to many."""
    rows = [(i, f"{i} " + "long text " * (1000 if i % 7 else 1)) for i in range(600)] + [(3, "twin"), (3, "twin"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition("doc_id")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        got = sorted(tokens.token_store(docs, public_tokenizers.path("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
        path = scratch_path(spark, "written")
        tokens.write_tokens(docs.where("doc_id is not null"), path, public_tokenizers.path("byte_bpe_50k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_an_order_that_only_narrow_plans_have_is_mended(spark, monkeypatch):
    docs = spark.range(0, 200, 1, 4).selectExpr("id as doc_id", "concat('t ', id) as text").repartition(3)
    monkeypatch.setattr(tokens, "in_order", lambda d: True)
    got = sorted(tokens.token_store(docs, public_tokenizers.path("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(200))


def test_the_store_has_the_layout_that_it_names(spark):
    """Footers: a dictionary for ids, deltas for sorted integers, row groups of a set size, page indexes."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "concat(repeat('some words ', 200), id) as text")
    path = scratch_path(spark, "layout")
    tokens.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    (name,) = glob.glob(path.removeprefix("file://") + "/*.parquet")
    file = pq.ParquetFile(name)
    group = file.metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    for c in ("doc_id", "part_start", "n_tokens"):
        assert "DELTA_BINARY_PACKED" in columns[c].encodings and not columns[c].has_dictionary_page
    ids = next(c for p, c in columns.items() if p.startswith("ids"))
    assert ids.has_dictionary_page and "RLE_DICTIONARY" in ids.encodings
    assert all(c.has_offset_index and c.has_column_index for p, c in columns.items() if not p.startswith("ids"))
    assert all(file.metadata.row_group(i).total_byte_size <= 48 << 20 for i in range(file.metadata.num_row_groups))


def test_empty_tables(spark, empty):
    assert tokens.token_store(empty, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("lengths", [[1], [2048], [2049], [1, 1, 1], [5000, 3, 700, 2048, 1], [100] * 200, list(range(1, 300))])
def test_packs_are_whole_and_full(lengths):
    pieces = packing.pack(lengths)
    filled = {}
    for _, _, n, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == filled.get(s, 0)
        filled[s] = offset + n
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())
    for doc, n in enumerate(lengths):
        own = sorted((a, k) for d, a, k, _, _ in pieces if d == doc)
        assert sum(k for _, k in own) == n and all(a == sum(k for b, k in own if b < a) for a, _ in own)


def test_descending_pieces_go_to_the_cheapest_sequence():
    cost = {}
    for _, _, n, s, _ in packing.pack([1000] * 8 + [48] * 8):
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    full = sorted(cost.values())[-4:]
    assert max(full) - min(full) < 200


def test_packed_documents(docs):
    encode = plain("word_bpe_49k.json")
    by_id = dict(docs.select("doc_id", "text").collect())
    rows = packing.pack_documents(docs.dropDuplicates(["doc_id"]), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in rows} == set(by_id)
    for r in rows:
        ids = encode(by_id[r.doc_id]) + [1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])


def test_what_tasks_leave_over_is_packed_again(spark):
    """Many small partitions: nearly all tokens are in full sequences, and each id is in one piece."""
    encode = plain("word_bpe_49k.json")
    docs = spark.range(0, 600, 1, 60).selectExpr("id as doc_id", "if(id = 7, null, concat(repeat(concat('some words ', id, ' '), cast(20 + id % 90 as int)), 'end')) as text")
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    by_id = {r.doc_id: encode(r.text or "") + [1] for r in docs.collect()}
    own, filled = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == crc(by_id[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(by_id[r.doc_id])
    assert own.keys() == by_id.keys()
    for i, pieces in own.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(by_id[i])
    for pieces in filled.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == pieces[0].sequence_tokens and (at & (at - 1)) == 0
    total = sum(len(v) for v in by_id.values())
    full = sum(r.length for r in rows if r.sequence_tokens == 2048)
    tail = [n for n in {s: p[0].sequence_tokens for s, p in filled.items()}.values() if n < 2048]
    # All left-overs fit in few tasks of the second pass, and each leaves less than one sequence.
    assert full >= 0.98 * total and sum(tail) < 2048 * max(1, -(-60 * 2048 // packing.REST_TOKENS))
