"""Every operator on a table with texts far longer than any batch."""

import hashlib
import random
import zlib

import pytest
import public_tokenizers

from tessera.llm import exact_dedup, language_id, mixing, near_dedup, packing, passages, sharding, tokens, toxicity, transport
from tests.llm.test_tokens_packing import crc, plain

RND = random.Random(3)
LONG = " ".join(f"word{RND.randint(0, 50_000)}" for _ in range(150_000))
ONE = "x" * 2_000_000
ROWS = [(1, LONG, "en", "a"), (2, ONE, "en", "a"), (3, "short text", "en", "b"), (4, LONG, None, None), (5, LONG + " end", "xx", "b"), (6, None, "xx", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").repartition(2)


def test_tokens_and_packing(docs):
    encode = plain("byte_bpe_50k.json")
    got = {r.doc_id: r for r in tokens.token_store(docs.where("doc_id in (3, 4, 6)"), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert all(got[i].ids_crc32 == crc([*encode(t), 0]) for i, t, *_ in ROWS if i in (3, 4, 6))
    pieces = packing.pack_documents(docs.where("doc_id in (3, 4, 6)"), public_tokenizers.path("word_bpe_49k.json")).collect()
    words = plain("word_bpe_49k.json")
    assert sum(p.length for p in pieces) == sum(len(words(t)) + 1 for i, t, *_ in ROWS if i in (3, 4, 6))


def test_copies(docs):
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs).collect()} == {1: 4, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1, 6: 6}
    rows = passages.repeated_passages(docs.coalesce(1)).collect()
    assert {r.doc_id for r in rows} | {r.source_doc_id for r in rows} == {1, 4, 5} and max(r.equal_words for r in rows) == 150_000


def test_models(docs, spark):
    assert len(language_id.identify_documents(docs).collect()) == 6
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 7)], "doc_id bigint, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, labels).collect())


def test_shards_mix_and_media(docs):
    sizes = {i: len((t or "").encode()) for i, t, *_ in ROWS}
    assert {r.doc_id: (r.size, r.text_crc32) for r in sharding.shard_documents(docs).collect()} == {i: (sizes[i] + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}
    assert {r.doc_id: r.size for r in mixing.take_mix(docs).collect()} == {i: len((t or "").split()) for i, t, *_ in ROWS}
    for r in transport.media_digest(docs).collect():
        raw = (dict((i, t) for i, t, *_ in ROWS)[r.doc_id] or "").encode()
        assert r.payload_sha256 == hashlib.sha256(raw.ljust(max(1, -(-len(raw) // 192)) * 192)).hexdigest()
