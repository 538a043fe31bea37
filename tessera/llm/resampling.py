"""Operator 11: importance resampling towards a target distribution, in two Arrow passes.

A text's features are its words and pairs of consecutive words, hashed into buckets by
CRC-32.  Pass 1 turns each partition into one vector of counts with ``np.bincount``; a
tree of reduces merges the vectors, so the driver sees one vector a table, whatever the
number of partitions.  The gain of a bucket is the log ratio of its smoothed share in the
target to that in the documents.  Pass 2 gathers the broadcast gains (one integer a
bucket) and sums them for each document with weighted ``np.bincount``.  The mean gain
plus Gumbel noise, a hash of doc_id, ranks the documents; the highest scores are drawn
without replacement.

Checksums are computed for all words at once: byte by byte over the words that are long
enough, and a pair's from those of its words, as CRC-32 is linear.

Null text has no features, a weight of 0 and is never drawn, like any text with fewer than
LEAST_WORDS words.  A null doc_id is hashed as empty text and sorts before others at
equal scores.  Repeated rows are separate documents with equal scores and ranks of their
own.  Texts of any length count whole.  Empty tables give empty results; against an empty
target all gains rest on smoothing alone.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, ordered_positions, text_bytes, text_slices

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Vectors that one task of the reducing tree merges.
FAN_IN = 64

#: Letters and digits, lower-cased, and bytes of other characters than ASCII make words.
_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: Words of more bytes are summed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte b at place k of the register becomes when n zero bytes follow."""
    steps = np.empty((_LONG + 1, 4, 256), np.uint32)
    steps[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_LONG):
        steps[n + 1] = _TABLE[steps[n] & 255] ^ (steps[n] >> 8)
    return steps


_SHIFT = _shifts()


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, the text that each belongs to, and each text's words.

    Words come first, then pairs; within either, features stand in the texts' order.
    """
    raw, offsets = text_bytes(texts)
    data = _LOWER[raw]
    ink = _WORD[raw]
    edge = np.append(True, ~ink[:-1])[: len(ink)]
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    begins = np.flatnonzero(ink & edge)
    stop = np.append(~ink[1:], True)[: len(ink)]
    stop[offsets[1:][offsets[1:] > 0] - 1] = True
    lengths = np.flatnonzero(ink & stop) + 1 - begins
    words = np.diff(np.searchsorted(begins, offsets))
    owner = np.repeat(np.arange(len(texts)), words)

    register = np.full(len(begins), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(lengths, _LONG + 1), kind="stable")
    by_length = lengths[order]
    long = int(np.searchsorted(-by_length, -_LONG))
    for i in order[:long].tolist():
        register[i] = zlib.crc32(data[begins[i] : begins[i] + lengths[i]]) ^ 0xFFFFFFFF
    at, state = begins[order[long:]], register[order[long:]]
    longer = len(at) - np.searchsorted(by_length[long:][::-1], np.arange(_LONG), "right")
    for k in range(_LONG):
        n = int(longer[k])
        if not n:
            break
        state[:n] = _TABLE[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    register[order[long:]] = state

    second = np.flatnonzero(owner[1:] == owner[:-1]) + 1 if len(owner) else np.zeros(0, np.int64)
    # The register behind "first ", less that at a text's begin, moved past the second word.
    head = register[second - 1]
    head = _TABLE[(head ^ 32) & 255] ^ (head >> 8) ^ np.uint32(0xFFFFFFFF)
    size = lengths[second]
    short = np.minimum(size, _LONG)
    pairs = register[second]
    for k in range(4):
        pairs = pairs ^ _SHIFT[short, k, (head >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(size > _LONG).tolist():
        w = second[i]
        before = int(head[i]) ^ 0xFFFFFFFF
        pairs[i] = zlib.crc32(data[begins[w] : begins[w] + lengths[w]], before ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    sums = np.concatenate([register, pairs]) ^ np.uint32(0xFFFFFFFF)
    return (sums % np.uint32(buckets)).astype(np.int64), np.concatenate([owner, owner[second]]), words


def _count(buckets: int):
    """A partition's vector of counts, one row whatever it holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in (s for b in batches for s in text_slices(b, "text")):
            total += np.bincount(features(batch.column("text"), buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; partitions' vectors are merged in a tree."""
    vectors = docs.select("text").mapInArrow(_count(buckets), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(buckets, np.int64)
    depth = 1
    while FAN_IN**depth < parts:
        depth += 1
    return vectors.treeReduce(lambda a, b: a + b, max(2, depth))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the source, rounded down."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh(gains, buckets: int):
    """Each document's words, features and mean gain."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value.astype(np.float64)
        for batch in (s for b in batches for s in text_slices(b, "text")):
            at, owner, words = features(batch.column("text"), buckets)
            n = np.bincount(owner, minlength=len(words))
            total = np.bincount(owner, gain[at], len(words)).astype(np.int64)  # whole numbers below 2**53
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document, by the texts of ``target``."""
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    held = docs.sparkSession.sparkContext.broadcast(gains)  # one integer a bucket
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_weigh(held, buckets), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: n_features, weight, score and its rank among those drawn, null for the others."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = importance_weights(docs, target, buckets).withColumn("score", F.col("weight") + noise)
    scored = materialize(scored.withColumn("_order", -F.col("score")), "scores")
    eligible = F.col("n_words") >= least_words
    drawn = scored.where(eligible).count() * percent // 100
    columns = ("doc_id", "n_features", "weight", "score")
    line = ordered_positions(scored.where(eligible), [], ["_order", "doc_id", "n_features"], "line")
    rank = F.when(F.col("_slot") < drawn, F.col("_slot") + 1)
    ranked = line.select(*columns, rank.cast("bigint").alias("rank"))
    return ranked.unionByName(scored.where(~eligible).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that are drawn, columns unchanged; all rows of a doc_id of which one is drawn."""
    ids = resample(docs, target, **options).where("rank is not null").select(F.struct("doc_id").alias("__key")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.struct("doc_id").alias("__key"))
    return rows.join(ids, "__key", "left_semi").select("__row.*")
