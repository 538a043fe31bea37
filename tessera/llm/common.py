"""What the corpus operators share: scratch tables, skew-safe joins, fixed-size
bit filters, ordered prefix offsets and columnar text handling in numpy.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Scratch tables
# --------------------------------------------------------------------------

_MADE: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local master
    without that setting (tests, a laptop) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}/{name}"
    _MADE.append((spark, path))
    return path


#: Scratch tables' row groups, and what an Arrow batch may hold: they bound a task's buffers.
SCRATCH_LAYOUT = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 256}


def bound_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batch sizes to BATCHES: whole texts may be long, and executors small."""
    for name, most in BATCHES.items():
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark


def materialize(df: DataFrame, name: str, compact: bool = False, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage; a lost executor costs no recomputation of what came before.
    ``compact`` is for narrow results of wide stages: they are dealt out anew by size,
    so that many tasks don't leave a tiny file each.
    """
    spark = bound_batches(df.sparkSession)
    path = scratch_path(spark, name)
    (df.hint("rebalance") if compact else df).write.options(**SCRATCH_LAYOUT | options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(made: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    _MADE.remove((made.sparkSession, made._scratch))
    _delete(made.sparkSession, made._scratch)


def remove_scratch() -> None:
    """Delete every scratch table made so far; results that still read one are void."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended already
            return


atexit.register(remove_scratch)

# --------------------------------------------------------------------------
# Joins and ordered offsets
# --------------------------------------------------------------------------

#: A class that holds over 1/HOT_SHARE of all rows, and LEAST_HOT rows, is hot; there are at most HOT_SHARE of them.
HOT_SHARE, LEAST_HOT = 1000, 100


def join_classes(rows: DataFrame, classes: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of rows to their class (one row a key) where a class may hold most rows.

    Classes of over ``total / HOT_SHARE`` rows number at most ``HOT_SHARE``, so
    broadcasting them has a proven bound and their rows aren't shuffled; the
    others are joined by an ordinary shuffle in which no key is large.
    """
    limit = F.lit(max(total // HOT_SHARE, LEAST_HOT))
    hot = classes.where(F.col(weight) > limit)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(F.col(weight) <= limit), key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def salted_join(rows: DataFrame, wide: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner join of rows to a wide row of their key (one a key), where a key may hold most rows.

    A key of more than ``total / HOT_SHARE`` rows is dealt out to as many salts as it holds
    that often, and its wide row is copied to each: the copies of all keys together number at
    most 2 * HOT_SHARE, and no salt holds much more than that share.  The salt is a hash of
    the row's narrow columns, so that a task that runs again deals alike.  ``counted``, rows
    itself if not given, is a table with those narrow columns and the same rows.
    """
    counted = rows if counted is None else counted
    counts = materialize(counted.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "salts", compact=True)
    limit = max((counts.agg(F.sum("__n")).head()[0] or 0) // HOT_SHARE, LEAST_HOT)
    hot = counts.where(F.col("__n") > limit).select(F.col(key), F.ceil(F.col("__n") / limit).cast("int").alias("__salts"))
    salt = F.pmod(F.xxhash64(*counted.columns), F.col("__salts")).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__salts") > 1, salt).otherwise(0)).drop("__salts")
    copies = wide.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def ordered_positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``_slot``: the row's gapless position from 0 within its group, by ``order``.

    A range partitioning by (group, order) spreads even one huge group over all
    tasks; positions are counted within partitions, then moved by the counts of
    the earlier partitions of the same group.  That table of counts has at most
    one row for each partition and one for each group boundary.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    table = table.withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = table.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    return table.join(F.broadcast(counts), [*group, "_part"]).withColumn("_slot", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")


# --------------------------------------------------------------------------
# Bit filters of fixed size
# --------------------------------------------------------------------------

#: Bits of one row of a filter table, and the most bits that a filter may have (8 MB).
CHUNK_BITS, MOST_BITS = 1 << 12, 1 << 26


def filter_bits(n: int) -> int:
    """log2 of the bits of a filter for n keys: about 32 bits a key, up to MOST_BITS."""
    return max(12, min(int(math.log2(MOST_BITS)), math.ceil(math.log2(max(1, n) * 32))))


def bit_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The filter table (chunk, words) over the top ``bits`` bits of a hash column."""
    at = F.shiftrightunsigned(F.col(key), 64 - bits)
    words = keys.select(F.shiftright(at, 12).alias("chunk"), F.shiftright(at.bitwiseAND(F.lit(CHUNK_BITS - 1)), 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{key}`, {64 - bits}) & 63 as int))").alias("bit"))
    words = words.groupBy("chunk", "word").agg(F.bit_or("bit").alias("bit"))
    entries = words.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bit"))).alias("m"))
    return entries.select("chunk", F.expr("transform(sequence(0, 63), i -> coalesce(try_element_at(m, i), 0L))").alias("words"))


def in_filter(df: DataFrame, key: str, filter_table: DataFrame, bits: int, flag: str | None = None) -> DataFrame:
    """Rows whose hash column ``key`` may be in the filter; with ``flag``, all rows and that column.

    The table is at most MOST_BITS / 8 bytes of words, whatever the data's size: safe to broadcast.
    """
    at = F.shiftrightunsigned(F.col(key), 64 - bits)
    table = filter_table.withColumnsRenamed({"chunk": "__chunk", "words": "__words"})
    joined = df.join(F.broadcast(table), F.shiftright(at, 12) == F.col("__chunk"), "left" if flag else "inner")
    hit = F.expr(f"getbit(element_at(__words, cast(shiftright(shiftrightunsigned(`{key}`, {64 - bits}) & {CHUNK_BITS - 1}L, 6) as int) + 1), cast(shiftrightunsigned(`{key}`, {64 - bits}) & 63 as int)) = 1")
    out = joined.withColumn(flag, F.coalesce(hit, F.lit(False))) if flag else joined.where(hit)
    return out.drop("__chunk", "__words")


# --------------------------------------------------------------------------
# Columnar text
# --------------------------------------------------------------------------

#: Bytes of text that numpy works on at once.
SLICE_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each cut holds about ``most`` bytes of text, one row at least."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and its len + 1 offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over the whole word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1024), _STEP, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, words for each text, and where each text's words begin.

    A word is a run of bytes other than 32 and 9 to 13; A-Z count as a-z.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ink = ~WHITE[data]
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False
    begins = np.flatnonzero(ink & ~before)
    counts = np.diff(np.searchsorted(begins, offsets))
    at = np.flatnonzero(ink)
    if not len(at):
        return np.zeros(0, np.uint64), counts, np.zeros(len(counts), np.int64)
    runs = np.searchsorted(at, begins)
    lengths = np.diff(np.append(runs, len(at)))
    place = np.arange(len(at)) - np.repeat(runs, lengths)
    values = (LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * _powers_to(int(lengths.max()))[place]
    hashes = mix64(np.add.reduceat(values, runs) + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return hashes, counts, np.cumsum(counts) - counts


def little_endian(ids: np.ndarray) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    return np.ascontiguousarray(ids, "<u4").tobytes()


def _running(value: str, group: str | None):
    """Adds ``_local``, the sum of ``value`` over this partition's earlier rows of the same group, and ``_part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            groups = batch.column(group).to_numpy(zero_copy_only=False) if group else np.zeros(len(values), np.int64)
            before = np.cumsum(values) - values
            firsts = np.flatnonzero(np.diff(groups, prepend=groups[0]) != 0)
            base = np.zeros(len(values), np.int64)
            base[firsts] = -np.diff(before[firsts], prepend=0)
            head = len(values) if not len(firsts) else firsts[0]
            local = before + np.cumsum(base)
            if groups[0] == last:
                local[:head] += held
            held, last = int(local[-1] + values[-1]), groups[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.full(len(values), part, np.int32))], [*batch.schema.names, "_local", "_part"])

    return run


def ordered_sums(df: DataFrame, value: str, group: str | None, order: list[str], name: str) -> DataFrame:
    """Adds ``_start``: the sum of ``value`` over all earlier rows of the group, by ``order``.

    ``group`` is a non-null integer column or None; ``value`` a non-null integer.
    As with ``ordered_positions``, no group is ever in one task.
    """
    keys = [*([group] if group else []), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _local bigint, _part int"
    table = materialize(ranged.mapInArrow(_running(value, group), schema), name)
    return add_bases(table.withColumnRenamed("_local", "_start"), value, group).drop("_part")


def part_bases(table: DataFrame, value: str, group: str | None) -> DataFrame:
    """For each (group, ``_part``): ``_base``, the sum of ``value`` over the group's earlier parts."""
    by = [group] if group else []
    sums = table.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))


def add_bases(table: DataFrame, value: str, group: str | None) -> DataFrame:
    """Moves ``_start``, counted within ``_part``, by the sums of the group's earlier parts.

    There is a row to broadcast for each part and for each boundary between groups.
    """
    bases = part_bases(table, value, group)
    return table.join(F.broadcast(bases), [*([group] if group else []), "_part"]).withColumn("_start", F.col("_start") + F.col("_base")).drop("_base")


def drop_rows(docs: DataFrame, key: Column, dropped: DataFrame, single: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, without those whose key is in ``dropped`` and with one alone of those whose key is in ``single``.

    Both tables have one column, the key.  Of the rows of a single key the one whose
    columns have the greatest hash stays.  Only rows that a bit filter lets through are
    shuffled; the others pass as they are.
    """
    marks = dropped.toDF("__key").distinct().withColumn("__single", F.lit(False)).unionByName(single.toDF("__key").distinct().withColumn("__single", F.lit(True)))
    marks = materialize(marks, "marks", compact=True)
    bits = filter_bits(marks.count())
    table = materialize(bit_filter(marks.select(F.xxhash64("__key").alias("__h")), "__h", bits), "filter", compact=True)
    keyed = docs.select(F.struct("*").alias("__row"), key.alias("__key")).withColumn("__h", F.xxhash64("__key"))
    flagged = in_filter(keyed, "__h", table, bits, flag="__maybe").drop("__h")
    checked = flagged.where("__maybe").join(marks, "__key", "left")
    stay = flagged.where("not __maybe").select("__row").unionByName(checked.where("__single is null").select("__row"))
    if not single.isEmpty():
        one = checked.where("__single").groupBy("__key").agg(F.max_by("__row", F.xxhash64("__row")).alias("__row"))
        stay = stay.unionByName(one.select("__row"))
    return stay.select("__row.*")
