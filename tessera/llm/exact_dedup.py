"""Operator 3: exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each partition sorts its 64-bit fingerprints, cuts them by owner (a prefix of
   the hash) and sends each owner a block of Golomb-coded gaps.
2. An owner decodes its blocks, finds fingerprints that occur twice, and answers
   with a bitmap over its stretch of the hash space.
3. The bitmaps together have a fixed greatest size, so they go to all partitions.
   Only rows on a set bit are suspects; their texts are grouped byte by byte, with
   partial aggregation first, so that a text shared by most rows costs one row a task.

A false suspect is found alone in its group and stays, so the result is exact.
Null text counts as empty; empty texts are equal to each other.  Repeated rows
with one doc_id are separate rows of one group, and all rows that carry the
largest doc_id count as kept; ``drop_exact_duplicates`` leaves one of them.  Null
doc_id sorts lowest.  Texts of any length are hashed and compared whole.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK_BITS, drop_rows, filter_bits, in_filter, join_classes, materialize

#: Fingerprints of one block: what a partition holds before it sends.
BLOCK = 1 << 20
#: Fingerprints that an owner is meant to hold at once.
OWNER_HOLDS = 1 << 21


def golomb_encode(values: np.ndarray, shift: int) -> bytes:
    """Golomb-Rice code of the gaps of sorted unsigned integers: all unary quotients, then all ``shift`` low bits."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    low = np.empty((len(gaps), shift), np.uint8)
    for b in range(shift):
        low[:, b] = (gaps >> np.uint64(shift - 1 - b)) & np.uint64(1)
    return np.packbits(np.concatenate([unary, low.reshape(-1)])).tobytes()


def golomb_decode(blob: bytes, n: int, shift: int) -> np.ndarray:
    """The n sorted integers of ``golomb_encode``."""
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(shift)
    begin = int(ends[-1]) + 1 if n else 0
    low = bits[begin : begin + n * shift].reshape(n, shift)
    for b in range(shift):
        gaps |= low[:, b].astype(np.uint64) << np.uint64(shift - 1 - b)
    return np.cumsum(gaps, dtype=np.uint64)


def _shift(n: int, span: int) -> int:
    """The Rice parameter for n values spread over 2**span."""
    return max(0, span - max(1, n).bit_length())


def _send(owner_bits: int):
    """Partition side: blocks for owners; a fingerprint that repeats here is sent twice, no more."""
    span = 64 - owner_bits

    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        seen, counts = np.unique(np.concatenate(parts), return_counts=True)
        values = np.repeat(seen, np.minimum(counts, 2))
        owners = (values >> np.uint64(span)).astype(np.int64) if owner_bits else np.zeros(len(values), np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True):
            own = values[a:b] & np.uint64((1 << span) - 1)
            rows.append((int(owners[a]), len(own), shift := _shift(len(own), span), golomb_encode(own, shift)))
        return pa.RecordBatch.from_pylist([dict(zip(("owner", "n", "shift", "blob"), r, strict=True)) for r in rows], pa.schema([("owner", pa.int32()), ("n", pa.int32()), ("shift", pa.int32()), ("blob", pa.binary())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= BLOCK:
                yield block(held)
                held = []
        if held and sum(map(len, held)):
            yield block(held)

    return run


def _answer(owner_bits: int, bits: int):
    """Owner side: the chunks of the duplicate bitmap that have a bit set."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded, owner = [], 0
        for batch in blocks:
            for o, n, shift, blob in zip(*(batch.column(c).to_pylist() for c in ("owner", "n", "shift", "blob")), strict=True):
                owner = o
                decoded.append(golomb_decode(blob, n, shift))
        values = np.sort(np.concatenate(decoded))
        twice = np.unique(values[1:][values[1:] == values[:-1]]) | np.uint64(owner << (64 - owner_bits) if owner_bits else 0)
        at = np.unique(twice >> np.uint64(64 - bits))
        words = np.zeros((0, CHUNK_BITS // 64), np.int64)
        chunks, where = np.unique(at // CHUNK_BITS, return_inverse=True)
        if len(chunks):
            flags = np.zeros((len(chunks), CHUNK_BITS), np.uint8)
            flags[where, at % CHUNK_BITS] = 1
            words = np.packbits(flags, axis=1, bitorder="little").view("<i8")
        lists = pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * (CHUNK_BITS // 64), pa.array(words.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int64)), lists], ["chunk", "words"])

    return run


def duplicate_bitmap(rows: DataFrame, fingerprint: str, n: int) -> tuple[DataFrame, int]:
    """The bitmap table of fingerprints that occur twice or more, and its log2 of bits."""
    bits = filter_bits(n)
    owner_bits = min(bits - 12, max(0, (n // OWNER_HOLDS).bit_length()) + 4)
    blocks = rows.select(fingerprint).mapInArrow(_send(owner_bits), "owner int, n int, shift int, blob binary")
    answer = _answer(owner_bits, bits)
    maps = blocks.groupBy("owner").applyInArrow(lambda t: pa.Table.from_batches(answer(iter(t.to_batches()))), "chunk bigint, words array<bigint>")
    return maps, bits


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: the row of its group that stays, the group's size, the text's SHA-256."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select("doc_id", F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("text_sha256")), "fingerprints")
    n = rows.count()
    maps, bits = duplicate_bitmap(rows, "fp", n)
    maps = materialize(maps, "bitmaps", compact=True)
    suspects = in_filter(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("fp")), "fp", maps, bits)
    classes = suspects.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = materialize(classes.select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "classes", compact=True)
    flagged = in_filter(rows, "fp", maps, bits, flag="suspect").drop("fp")
    joined = join_classes(flagged.where("suspect").drop("suspect"), classes, "text_sha256", "group_size", n)
    alone = flagged.where("not suspect").select("text_sha256", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    return joined.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, of which each text keeps one: of rows that share doc_id and text too, that with the greatest hash."""
    found = materialize(exact_duplicates(docs).select(F.struct("doc_id", "text_sha256").alias("key"), "kept", "group_size"), "duplicates")
    twins = found.where("kept and group_size > 1").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return drop_rows(docs, key, found.where("not kept").select("key"), materialize(twins.select("key"), "twins", compact=True))
