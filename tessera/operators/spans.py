"""Exact search of many spans in many texts by an index of rolling hashes.

Of the windows of a text those are kept that have the least hash among neighbours
(winnowing): any span of ``least`` bytes or more keeps, wherever it stands, at least the
window that is least among its own first ones.  So a span is looked up by one hash, the
rarest of those that it keeps, and what is found is confirmed in the text itself.  Of a
text's windows only those leave their task that pass a bit filter of the hashes looked up.
Short spans are confirmed in the bytes around the window; for others texts stay rows: a text
is shuffled once, to the spans that may stand in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tessera.functions.scalars import LINE_BREAK, strip
from tessera.operators.documents import share
from tessera.sources.scratch import folder

#: Least bytes of a span and width of the windows by which it is searched, shortest first.
TIERS = ((1, 1), (2, 2), (3, 3), (4, 4), (20, 17), (40, 34), (120, 64))
#: Bytes of text that numpy works on at once; spans that a text is searched for in one row.
SLICE, SPANS_A_ROW = 1 << 20, 1000
#: Sources by which it is estimated how common a key is (results don't depend on it), and keys of a span that are looked up.
SAMPLE, FEW = 1 << 12, 1
#: log2 of the bits of the greatest filter (8 MB), and least bytes of spans that are confirmed around their window.
MOST_BITS, AROUND = 26, 20

_BASE, _ODD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` bytes, by doubling."""
    part, size, done, out = data.astype(np.uint64) + np.uint64(1), 1, 0, None
    while True:
        if width & size:
            if out is None:
                out = part
            else:
                n = len(data) - done - size + 1
                out = out[:n] + part[done : done + n] * np.uint64(pow(_BASE, done, 1 << 64))
            done += size
        if size * 2 > width:
            break
        n = len(part) - size
        part = part[:n] + part[size : size + n] * np.uint64(pow(_BASE, size, 1 << 64))
        size *= 2
    out = (out ^ (out >> np.uint64(32))) * _ODD
    return out ^ (out >> np.uint64(29))


def _sliding(values: np.ndarray, n: int, best) -> np.ndarray:
    """The least (or greatest) of each n neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (n - size)], values[n - size :]) if size < n else values


def windows(data: np.ndarray, offsets: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts the windows that are kept: text, place in the data, and hash."""
    k = least - width + 1
    if len(data) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.maximum(_rolling(data, width), np.uint64(1))
    lowest = _sliding(hashes, k, np.minimum)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[: len(lowest)] == owner[least - 1 : least - 1 + len(lowest)]
    lowest = np.where(whole, lowest, np.uint64(0))
    # A window is kept if a group of k that holds it has it as its least.
    padded = np.concatenate([np.zeros(k - 1, np.uint64), lowest, np.zeros(k - 1, np.uint64)])
    kept = np.flatnonzero((_sliding(padded, k, np.maximum) == hashes))
    return owner[kept], kept, hashes[kept]


def winnowed(data: np.ndarray, offsets: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of concatenated texts the distinct (text, hash) of the windows that are kept."""
    return _distinct(*windows(data, offsets, width, least)[::2])


def _distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))[: len(owner)]
    return owner[new], hashes[new]


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's two bits in a filter: its high and its low ones."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


def _may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a filter, a power of two of 64-bit words."""
    bits, at = (len(words) - 1).bit_length() + 6, np.arange(len(keys))
    for slot in (0, 1):
        own = _slots(keys[at], bits)[slot]
        at = at[(words[own >> 6] >> (own & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return at


def _filter(keys: DataFrame):
    """A broadcast filter of the column ``key``: 16 bits a key, at most 2^MOST_BITS bits whatever their number."""
    rows = keys.select("key").distinct()
    bits = max(12, min(MOST_BITS, math.ceil(math.log2(max(1, rows.count()) * 16))))
    slots = F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))
    set_ = rows.select(F.explode(slots).alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    found = set_.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def _keys(batches: Iterator[pa.RecordBatch], width: int, least: int, held=None, reach: int | None = None) -> Iterator[pa.RecordBatch]:
    """(id, key) of rows (id, text), of keys that ``held`` may hold; with ``reach`` also so many bytes on both sides of each window."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts, size = [0], 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > SLICE:
                cuts.append(i)
                size = 0
            size += n
        for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
            own = batch.slice(a, b - a)
            raw, offsets = b"".join(x or b"" for x in own.column("text").cast(pa.binary()).to_pylist()), np.append(0, np.cumsum(sizes[a:b]))
            at, place, hashes = windows(np.frombuffer(raw, np.uint8), offsets, width, least)
            if held is not None:
                may = _may_hold(held.value, hashes)
                at, place, hashes = at[may], place[may], hashes[may]
            around = []
            if reach is None:
                at, hashes = _distinct(at, hashes)
            else:
                lows, highs = np.maximum(offsets[at], place - reach), np.minimum(offsets[at + 1], place + width + reach)
                around = [pa.array([raw[u:v] for u, v in zip(lows.tolist(), highs.tolist(), strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([own.column("id").take(pa.array(at)), pa.array(hashes.view(np.int64)), *around], ["id", "key", "around"][: 2 + len(around)])


def _index(rows: DataFrame, width: int, least: int, held=None, reach: int | None = None) -> DataFrame:
    """(id, key) of rows (id, text), with the bytes around the window if ``reach`` is given."""
    schema = StructType([rows.schema["id"], StructField("key", LongType()), *([StructField("around", BinaryType())] if reach is not None else [])])
    return rows.where(F.octet_length("text") >= least).select("id", "text").mapInArrow(partial(_keys, width=width, least=least, held=held, reach=reach), schema)


def _kept(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _confirmed(candidates: DataFrame, spans: DataFrame, sources: DataFrame) -> DataFrame:
    """Of pairs (span_id, id) those whose text holds the span; each text meets its spans SPANS_A_ROW at a time."""
    pairs = candidates.join(spans, "span_id").withColumn("deal", F.pmod(F.xxhash64("span_id"), F.lit(64)))
    lists = pairs.groupBy("id", "deal").agg(F.collect_list(F.struct("span_id", "span")).alias("spans"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("spans") - 1) / SPANS_A_ROW).cast("int")), lambda i: F.slice("spans", i * SPANS_A_ROW + 1, SPANS_A_ROW))
    lists = lists.select("id", F.explode(pieces).alias("spans"))
    # Written first: few of them are broadcast by their size, and the texts stay where they are.
    lists = _kept(lists)
    held = F.transform(F.filter("spans", lambda s: F.contains(F.col("text"), s["span"])), lambda s: s["span_id"])
    return lists.join(sources, "id").select("id", F.explode(held).alias("span_id"))


def _tiers(spans: DataFrame) -> list[tuple[int, int, int | None, DataFrame]]:
    """The spans of each tier that has any, with the least bytes, the width, and the bytes that none reaches."""
    rows = spans.withColumn("size", F.octet_length("span")).where("size > 0")
    tops = [*(t[0] for t in TIERS[1:]), None]
    there = {r[0] for r in rows.select(F.coalesce(*(F.when(F.col("size") < t, i) for i, t in enumerate(tops) if t), F.lit(len(TIERS) - 1))).distinct().collect()}
    inside = lambda i: (F.col("size") >= TIERS[i][0]) & (F.col("size") < tops[i] if tops[i] else F.lit(True))
    return [(least, width, tops[i], rows.where(inside(i)).drop("size")) for i, (least, width) in enumerate(TIERS) if i in there]


def occurrences(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """All pairs (span_id, id) of spans (span_id, span) and sources (id, text) that hold them.

    Null and empty spans and texts match nothing; equal ids of different texts count as one
    source.  The result is as large as what there is to find.
    """
    parts = []
    for least, width, _, own in _tiers(spans):
        probes = _kept(_index(own.select(F.col("span_id").alias("id"), F.col("span").alias("text")), width, least).withColumnRenamed("id", "span_id"))
        index = _kept(_index(sources, width, least, _filter(probes)).join(probes.select("key").distinct(), "key", "left_semi"))
        chosen = _rarest(probes, index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")))
        parts.append(_confirmed(chosen.join(index, "key").select("span_id", "id").distinct(), own, sources.select("id", "text")).distinct())
    if not parts:
        return spans.join(sources.select("id"), F.lit(False)).select("span_id", "id")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) where a passage (item_id, text) stands in a document (doc_id, text); white passages stand nowhere."""
    spans = passages.where("trim(text) != ''").select(F.col("item_id").alias("span_id"), F.col("text").alias("span"))
    return occurrences(spans, docs.select(F.col("doc_id").alias("id"), "text")).select(F.col("id").alias("doc_id"), F.col("span_id").alias("item_id"))


def _rarest(probes: DataFrame, ends: DataFrame) -> DataFrame:
    """(span_id, key, a, b): of each span's keys that of the fewest sources, with its least and greatest; a span with a key that no source has is nowhere."""
    n = F.coalesce("n", F.lit(0))
    known = probes.join(ends, "key", "left").groupBy("span_id").agg(F.min(F.struct(n.alias("n"), "key", "a", "b")).alias("k"))
    return known.where("k.n > 0").select("span_id", "k.key", "k.a", "k.b")


def _least_common(probes: DataFrame, sources: DataFrame, width: int, least: int) -> DataFrame:
    """Of each span's keys the FEW that the fewest of a sample of sources have."""
    every = max(1, sources.count() // SAMPLE)
    common = _index(sources.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), width, least).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = probes.join(common, "key", "left").groupBy("span_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("keys"))
    return ranked.select("span_id", F.explode(F.slice("keys", 1, FEW)).alias("k")).select("span_id", "k.key")


def first_and_last(spans: DataFrame, sources: DataFrame, both: bool = True) -> DataFrame:
    """J10, T1.8: for each span (span_id, span) that stands anywhere, two ids of sources that hold it, equal if only one does.

    A key's least and greatest source are tried first; only spans that these don't settle
    are looked for in all sources of their key, so that a span which most sources hold
    costs two tests.  The two ids needn't be the least and greatest of all; without
    ``both`` a span is settled by the first that holds it.  With columns ``low`` and ``high``
    (the ids of the sources that a span was taken from) a span that can stand in no other
    isn't looked up, nor returned.
    """
    texts, parts = sources.select("id", "text"), []
    owned = "low" in spans.columns
    for least, width, top, own in _tiers(spans):
        probes = _kept(_index(own.select(F.col("span_id").alias("id"), F.col("span").alias("text")), width, least).withColumnRenamed("id", "span_id"))
        probes = _kept(_least_common(probes, texts, width, least))
        near = top is not None and least >= AROUND
        if near:
            # Places whose surroundings are equal are one row, so copies of a passage cost no more than one.
            index = _index(texts, width, least, _filter(probes), top - 1 - width).groupBy("key", "around").agg(F.min("id").alias("a"), F.max("id").alias("b"))
            index = _kept(index.join(probes.select("key").distinct(), "key", "left_semi"))
            ends = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
        else:
            index = _kept(_index(texts, width, least, _filter(probes)).join(probes.select("key").distinct(), "key", "left_semi"))
            ends = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
        chosen = _rarest(probes, ends)
        if owned:
            chosen = chosen.join(own.select("span_id", "low", "high"), "span_id").where("not (low <=> a and low <=> b and high <=> a)")
        chosen = _kept(chosen.select("span_id", "key", "a", "b"))
        if near:
            first = index.groupBy("key").agg(F.array_distinct(F.array(F.min(F.struct("a", "around", "b")), F.max(F.struct("a", "around", "b")))).alias("tried"))
            tried = first.select("key", F.explode("tried").alias("t")).select("key", "t.a", "t.around", "t.b")
            pair = lambda rows, places: _around(rows, places, own.select("span_id", "span"))  # noqa: E731, B023
            hits = _kept(pair(chosen.select("span_id", "key"), tried))
            # All places of a key were tried if there were two at most.
            alone = chosen.join(ends.where("n <= 2").select("key"), "key", "left_semi").select("span_id")
        else:
            pair = lambda rows, places: _confirmed(rows.join(places, "key").select("span_id", "id").distinct(), own.select("span_id", "span"), texts).groupBy("span_id").agg(F.min("id").alias("first"), F.max("id").alias("last"))  # noqa: E731, B023
            ones = chosen.select("span_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
            hits = _kept(_confirmed(ones, own.select("span_id", "span"), texts).groupBy("span_id").agg(F.min("id").alias("first"), F.max("id").alias("last")))
            alone = chosen.where("a = b").select("span_id")
        settled = hits.where("first <> last" if both else "true").select("span_id").unionByName(alone)
        open_ = _kept(chosen.join(settled, "span_id", "left_anti").select("span_id", "key"))
        if open_.isEmpty():
            parts.append(hits)
        else:
            parts.append(hits.join(settled, "span_id", "left_semi").unionByName(pair(open_, index)))
    if not parts:
        return spans.join(sources.select("id"), F.lit(False)).select("span_id", F.col("id").alias("first"), F.col("id").alias("last"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _around(rows: DataFrame, places: DataFrame, spans: DataFrame) -> DataFrame:
    """(span_id, first, last) of rows (span_id, key) whose span stands around places (key, around, a, b) of their key."""
    found = rows.join(spans, "span_id").join(places, "key").where(F.contains("around", F.col("span").cast("binary")))
    return found.groupBy("span_id").agg(F.min("a").alias("first"), F.max("b").alias("last"))


def _looked_up(pieces: DataFrame, sources: DataFrame, others: bool) -> DataFrame:
    """Pieces (doc_id, span) as (doc_id, size, found): whether any source, or any but the document itself, holds the span."""
    # 128 bits of a hash stand for a span wherever its text isn't needed.
    named = pieces.withColumn("span_id", F.unhex(F.left(F.sha2("span", 256), F.lit(32))))
    owners = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")] if others else []
    spans = _kept(named.groupBy("span_id").agg(F.first("span").alias("span"), *owners) if others else named.select("span_id", "span").distinct())
    places = first_and_last(spans, sources, both=others)
    rows = named.select("doc_id", "span_id", F.length("span").alias("size")).join(places, "span_id", "left")
    own = F.col("doc_id")
    found = F.col("first").isNotNull() & ((F.col("first") != own) | (F.col("last") != own)) if others else F.col("first").isNotNull()
    return rows.withColumn("found", F.coalesce(found, F.lit(False)))


def traceable_quotes(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """J10, T1.8: per document (doc_id, text) its quotes of 20 characters or more, and how many stand in any source (id, text)."""
    quotes = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([^`\n]{20,})`"), 1)).alias("span"))
    counted = _looked_up(quotes, sources, others=False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("quotes"), F.count_if("found").alias("traceable"))
    return docs.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("traceable", F.lit(0)).alias("traceable"))


def copied_share(docs: DataFrame, sources: DataFrame, others: bool = False) -> DataFrame:
    """T1.8: per document the share of its text in lines of 120 characters or more that stand in a source.

    With ``others`` the sources have the documents' ids, and a document isn't its own
    source.  Null text has a share of 0.
    """
    lines = docs.select("doc_id", F.explode(F.transform(F.split("text", LINE_BREAK), strip)).alias("span")).where(F.length("span") >= 120)
    sums = _looked_up(lines, sources, others).where("found").groupBy("doc_id").agg(F.sum("size").alias("copied"))
    whole = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return whole.join(sums, "doc_id", "left").select("doc_id", share(F.coalesce("copied", F.lit(0)), F.col("chars")).alias("copied"))


