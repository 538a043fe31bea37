"""Operator 1: token ids in Parquet list columns, with selective reads.

Documents are range-partitioned by doc_id, tokenized in place and written in that
order.  ``ids`` is a list column, dictionary-coded; doc_id and the offsets are
delta-coded; row groups and pages have set sizes, and page indexes let a reader of
a doc_id range, or of metadata alone, skip the rest.  Offsets are stored from the
part's begin; the reader moves them by the sums of the earlier parts.

Null text counts as empty.  Texts of any length are encoded whole.  Ties of doc_id are
ordered by the text's hash; repeated rows are separate documents; null doc_id comes
first.  An empty table writes a readable, empty store.  Other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import little_endian, scratch_path, text_slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces of text whose ids a worker remembers, and of those the ones that came back after being forgotten.
MOST_PIECES, MOST_CORE = 400_000, 280_000

#: Letters below this code point are letters, and composed, in every Unicode version.
_LATIN = "\u0250"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies' letter for each byte: printable ones stand for themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Punctuation that makes one word of its own behind letters; an apostrophe may not.
_POINTS = b"!#$%&()*+,-./:;<=>?@[]^_{|}~"
_TEXT_POINTS = _POINTS.decode()
_ID = attrgetter("id")


class _Pieces(dict):
    """Ids of pieces, made when first asked for.

    When full it forgets all but the core: pieces that were asked for again after
    an earlier forgetting.  So frequent pieces stay and memory is bounded.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.core, self.gone = make, {}, frozenset()

    def __missing__(self, piece):
        if len(self) >= MOST_PIECES:
            self.gone = frozenset(self)
            self.clear()
            self.update(self.core)
        ids = self.make(piece)
        self[piece] = ids
        if piece in self.gone and len(self.core) < MOST_CORE:
            self.core[piece] = ids
        return ids


class PieceEncoder:
    """A tokenizers file, with the ids of pieces of text remembered.

    Both kinds of vocabulary cut text at white space before they merge, so a text
    may be cut there first and each distinct piece be encoded once.  ``lower`` (the
    kind that drops white space) cuts at any ASCII white space.  The other kind keeps
    a single space or line feed with the piece after it; a text in which white
    space stands in any other way is encoded whole.  A piece of Latin letters alone
    is one word to the library's pre-tokenizer and goes to its merges at once.

    A text that may hold an added token of the vocabulary (an end marker, say) is encoded
    whole, so it gets what the library gives it by default.
    """

    def __init__(self, path: str, lower: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Two characters tell that an added token may follow; normalizers change the case at most of such.
        self.marks = sorted({t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.merge, self.letters, self.lower = self.tokenizer.model.tokenize, _byte_letters(), lower
        self.pieces = _Pieces(self._lower_piece if lower else self._spaced_piece)
        self.heads, self.tails = _Pieces(self._head), _Pieces(self._whole)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, before: str = "") -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", map(_ID, self.merge(before + word))).tobytes()

    def _lower_piece(self, piece: bytes) -> bytes:
        stem = piece.rstrip(_POINTS)
        if stem != piece and (letters := stem.decode()).isalpha() and max(letters) < _LATIN and len(letters.lower()) == len(letters):
            return self.pieces[stem] + self.tails[piece[len(stem) :].decode()]
        text = piece.decode()
        word = text.lower()
        return self._word(word) if word.isalpha() and len(word) == len(text) and max(word) < _LATIN else self._whole(text)

    def _spaced_piece(self, piece: str) -> bytes | None:
        """None where the piece's ends may belong to white space around it."""
        if piece.isalpha() and max(piece) < _LATIN:
            return self._word(piece, self.letters[32])
        if (stem := piece.rstrip(_TEXT_POINTS)) != piece and stem.isalpha() and max(stem) < _LATIN:
            return self.pieces[stem] + self.tails[piece[len(stem) :]]
        if piece[:1] == "\n" and piece[1:].isalpha() and max(piece) < _LATIN:
            return self.tails["\n"] + self._word(piece[1:])
        body = piece[1:] if piece[:1] == "\n" else piece
        return self._whole(piece if piece[0] == "\n" else " " + piece) if body and body == body.strip() else None

    def _head(self, piece: str) -> bytes | None:
        return self._whole(piece) if piece and piece == piece.strip() else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        get, out = self.pieces.__getitem__, []
        for text in texts:
            if any(mark in text or mark.isupper() != mark.islower() and mark in text.lower() for mark in self.marks):
                out.append(self._whole(text))
                continue
            if self.lower:
                out.append(b"".join(map(get, text.encode().split())))
                continue
            rest = text.replace("\n", " \n").split(" ")
            head = rest.pop(0)
            try:
                out.append(self.heads[head] + b"".join(map(get, rest)))
            except TypeError:  # white space stands apart from the plain form
                out.append(self._whole(text))
        return [x.tobytes() for x in (np.frombuffer(b, np.uint32).astype("<u4", copy=False) for b in out)] if sys.byteorder == "big" else out


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, lower: bool) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    if (path, lower) not in _encoders:
        _encoders[path, lower] = PieceEncoder(path, lower)
    return _encoders[path, lower]


def _tokenize(path: str, lower: bool, end: int):
    """Rows (doc_id, text) in order, to rows with ids and the offset from the part's begin."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc, stop = TaskContext.get().partitionId(), 0, encoder(path, lower), little_endian(np.array([end]))
        for batch in (s for b in batches for s in text_slices(b, "text")):
            blobs = [x + stop for x in enc.encode([t or "" for t in batch.column("text").to_pylist()])]
            counts = np.array([len(b) // 4 for b in blobs], np.int64)
            ends = np.cumsum(counts)
            ids = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(at + ends - counts), pa.array(counts), ids], ["doc_id", "part", "part_start", "n_tokens", "ids"])
            at += int(ends[-1])

    return run


#: The store's layout.  Sorted integers are delta-coded (version 2 pages, no dictionary).
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def _apart(rows: DataFrame, part: Column) -> bool:
    """Whether parts hold disjoint ranges of doc_id without nulls."""
    ranges = rows.groupBy(part.alias("p")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    before = F.lag("high").over(Window.orderBy("low"))
    return bool(ranges.select(((F.col("nulls") > 0) | (F.col("low") <= before)).alias("bad")).agg(F.coalesce(F.bool_or("bad"), F.lit(False))).head()[0] is False)


def in_order(docs: DataFrame) -> bool:
    """Whether the partitions of this very plan hold disjoint ranges of doc_id."""
    return _apart(docs, F.spark_partition_id())


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, lower: bool = False, end: int = 0) -> None:
    """Write the ids of all whole texts, each followed by ``end``, in ascending doc_id order.

    Input whose partitions seem to hold disjoint ranges of doc_id, as stored tables mostly
    do, is sorted where it lies.  That is judged by reading the ids alone, which may be
    partitioned in another way than whole rows; so the written parts are judged too, by
    their metadata, and written again if they overlap.  Any other input is range-partitioned.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, part_start bigint, n_tokens bigint, ids array<int>"

    def write(dealt: DataFrame, mode: str = "errorifexists") -> None:
        sorted_rows = dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
        sorted_rows.mapInArrow(_tokenize(tokenizer, lower, end), schema).write.mode(mode).options(**LAYOUT).parquet(path)

    ranged = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie")
    if not in_order(docs.select("doc_id")):
        write(ranged)
        return
    write(rows)
    if not _apart(docs.sparkSession.read.parquet(path).select("doc_id", "part"), F.col("part")):
        write(ranged, "overwrite")


def _open(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumnsRenamed({"part": "_part", "part_start": "_start"})


def _placed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Moves offsets within parts to offsets over the whole store; there is a base for each part."""
    sums = table.groupBy("_part").agg(F.sum("n_tokens").alias("_sum"), F.min("doc_id").alias("_first"))
    before = Window.orderBy(F.col("_first").asc_nulls_first(), "_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_part").withColumn("start", F.col("_start") + F.col("_base")).drop("_part", "_start", "_base")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of all documents; reads no ids."""
    table = _open(spark, path)
    return _placed(table.drop("ids"), table)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids, of a range of doc_id if given: other row groups and pages are skipped."""
    table = _open(spark, path)
    wanted = table if first is None else table.where(F.col("doc_id") >= first)
    return _placed(wanted if last is None else wanted.where(F.col("doc_id") <= last), table)


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, at = little_endian(lists.flatten().to_numpy()), lists.offsets.to_numpy().astype(np.int64) * 4
        at = at - (at[0] if len(at) else 0)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_part", "_start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "_part", "_start", "n_tokens", "ids_crc32"])


def token_store(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a store, read it back, and give each document's place and its ids' checksum."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    table = _open(spark, path)
    kind = table.schema["doc_id"].dataType.simpleString()
    rows = table.mapInArrow(_checksums, f"doc_id {kind}, _part int, _start bigint, n_tokens bigint, ids_crc32 bigint")
    return _placed(rows, table).select("doc_id", "start", "n_tokens", "ids_crc32")
