"""Operator 5: cost-balanced packing of tokenized documents into sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays
within pieces).  Each task packs blocks of its documents: pieces in descending
length go to the sequence of lowest cost with room.  A piece that fits nowhere is
cut to fill the roomiest sequence, and its rest takes its turn by length.

A block has as many sequences as its tokens fill.  What is left over of all tasks'
blocks, less than a sequence each, meets once more, dealt by hash, and is packed alike.
Only what a task of that second pass leaves over becomes sequences of powers of two.
So no sequence is padded, and few are short: where tasks have BLOCK_TOKENS tokens or more,
a block leaves over less than a sequence, and so does each task of the second pass.
Null text is empty and still has its end token.  Texts of any length are encoded
whole; of documents of equal length the later one in the block is placed first.
Which pieces and sequences there are depends on how the input is partitioned; all ids
are in them once in any case.  Repeated rows are packed as separate documents; other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import little_endian, materialize, text_slices
from tessera.llm.tokens import encoder

#: Tokens that are packed together.
BLOCK_TOKENS = 1 << 20
#: Left-over tokens of a task of the second pass, while such tasks are few.
REST_TOKENS = 1 << 16


def pack(lengths: list[int], capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover all documents."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
    room, cost = list(sizes), [0.0] * len(sizes)
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # pieces by length
    for doc, n in enumerate(lengths):
        for start in range(0, n, capacity):
            waiting[min(capacity, n - start)].append((doc, start))
    closed: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by room, where the present length doesn't fit
    for s, n in enumerate(sizes):
        closed[n].append(s)
    heap: list[tuple[float, int]] = []
    out: list[tuple[int, int, int, int, int]] = []

    def place(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, s, sizes[s] - room[s]))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n in range(capacity, 0, -1):
        for s in closed[n]:
            heapq.heappush(heap, (cost[s], s))
        closed[n] = []
        pieces = waiting[n]
        while pieces:
            doc, start = pieces.pop()
            if heap:
                _, s = heapq.heappop(heap)
                place(doc, start, n, s)
                if room[s] >= n:
                    heapq.heappush(heap, (cost[s], s))
                elif room[s]:
                    closed[room[s]].append(s)
                continue
            most = next(r for r in range(n - 1, 0, -1) if closed[r])
            s = closed[most].pop()
            place(doc, start, most, s)
            waiting[n - most].append((doc, start + most))
    return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]


def _placed(columns: dict, capacity: int, first: int, kind: pa.DataType, keep_rest: bool) -> tuple[pa.RecordBatch, int]:
    """Packs stretches of documents (their ids as bytes ``blob``, their ``start``, their documents' ``doc_tokens``).

    With ``keep_rest``, pieces in sequences below the capacity have their ids as bytes in ``rest``.
    """
    blobs = columns["blob"]
    pieces = pack([len(b) // 4 for b in blobs], capacity)
    doc, start, length, sequence, offset = np.array(pieces, np.int64).T
    filled = np.bincount(sequence, length).astype(np.int64)
    ids = [blobs[d][4 * a : 4 * (a + n)] for d, a, n, _, _ in pieces]
    crc = np.array([zlib.crc32(b) for b in ids], np.int64)
    begin, whole = (np.array(columns[c], np.int64)[doc] for c in ("start", "doc_tokens"))
    out = [pa.array([columns["doc_id"][d] for d in doc], kind), *map(pa.array, (begin + start, length, crc, whole, first + sequence, offset, filled[sequence]))]
    if keep_rest:
        out.append(pa.array([b if filled[s] < capacity else None for b, s in zip(ids, sequence, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, [*NAMES, *(["rest"] if keep_rest else [])]), first + len(filled)


def _in_blocks(stretches: Callable, capacity: int, series: int, keep_rest: bool) -> Callable:
    """A task's side: the stretches of its batches in blocks of BLOCK_TOKENS, packed; sequences are numbered by series, partition and turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, n, kind = series << 62 | TaskContext.get().partitionId() << 33, {}, 0, None
        for kind, columns in stretches(batches):
            for c, values in columns.items():
                held.setdefault(c, []).extend(values)
            n += sum(map(len, columns["blob"])) // 4
            if n >= BLOCK_TOKENS:
                out, first = _placed(held, capacity, first, kind, keep_rest)
                yield out
                held, n = {}, 0
        if n:
            yield _placed(held, capacity, first, kind, keep_rest)[0]

    return run


def _encoded(tokenizer: str, end: int) -> Callable:
    """Whole documents, encoded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, dict]]:
        enc, stop = encoder(tokenizer, True), little_endian(np.array([end]))
        for batch in batches:
            for cut in text_slices(batch, "text"):
                blobs = [x + stop for x in enc.encode([t or "" for t in cut.column("text").to_pylist()])]
                yield batch.column("doc_id").type, {"doc_id": cut.column("doc_id").to_pylist(), "blob": blobs, "start": [0] * len(blobs), "doc_tokens": [len(b) // 4 for b in blobs]}

    return run


def _left_over(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, dict]]:
    """Pieces that the first pass left over."""
    for batch in batches:
        yield batch.column("doc_id").type, {c: batch.column(d).to_pylist() for c, d in (("doc_id", "doc_id"), ("blob", "rest"), ("start", "start"), ("doc_tokens", "doc_tokens"))}


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 2048) -> DataFrame:
    """All documents' tokens in sequences; one row per piece.  Only pieces that blocks leave over are shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = materialize(texts.mapInArrow(_in_blocks(_encoded(tokenizer, end), capacity, 0, True), schema + ", rest binary"), "pieces")
    rest = pieces.where("rest is not null").select("doc_id", "start", "length", "doc_tokens", "rest")
    n = rest.agg(F.sum("length")).head()[0] or 0
    # Few tokens meet in few tasks, so that little is left over again; many in tasks of a block each.
    tasks = max(-(-n // BLOCK_TOKENS), min(64, -(-n // REST_TOKENS)), 1)
    again = rest.repartition(tasks, "doc_id", "start").mapInArrow(_in_blocks(_left_over, capacity, 1, False), schema)
    return pieces.where("rest is null").drop("rest").unionByName(again)
