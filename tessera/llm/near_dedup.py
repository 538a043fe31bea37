"""Operator 8: near-duplicates by b-bit MinHash, with exact confirmation.

1. One scan gives each document the hash of its shingle set, BANDS * ROWS minima,
   a key for each band, and the minima's low BITS bits packed into a signature.
   Documents with equal sets are one node from here on.
2. Band keys that occur twice give candidate buckets.  Candidates are compared by
   signature: equal low bits are counted, corrected for chance, and pairs more than
   five standard errors below the threshold are dropped.
3. What is left is confirmed on full sets, read again for these documents alone.

No bucket's pairs are all formed.  First each member meets only its bucket's hub,
the member that shares most buckets with others; links so found join most of a
group at once.  Only buckets that still hold several components go on.  There a
first pass over signatures keeps the members that are like a member of another
component; a second one has their full sets and gives the links that join
components, fewer than the bucket has members.  Both passes work on blocks of
bounded size.  A large bucket is dealt out as pairs of blocks, so no task ever holds
a bucket; members of its largest component meet only blocks of the others, so a
bucket of which nearly all is joined is written about once.  Joins on a bucket, a
hub or a component deal out those that hold many rows (``join_classes``,
``salted_join``).  A pair at the threshold shares no band with probability
(1 - 0.8 ** ROWS) ** BANDS, under 3e-6; nothing else is lost.

Words are lower-cased in A-Z only.  A document with fewer words than a shingle is
one shingle; without words it is empty, linked with nothing.  Null text is empty.
Texts of any length are read whole.  Equal rows are equal nodes, rows of one doc_id
too, and ``drop_near_duplicates`` goes by rows, not by doc_id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bit_filter, discard, drop_rows, filter_bits, hash_words, in_filter, join_classes, materialize, mix64, salted_join, text_bytes, text_slices
from tessera.llm.components import components
from tessera.llm.exact_dedup import duplicate_bitmap

BANDS, ROWS, BITS = 42, 6, 4
#: Minima: those of the bands and a few more for the signature; bytes of a signature.
MINIMA = 256
SIGNATURE = MINIMA * BITS // 8
#: Shingles of a block of a bucket, of which each member counts MEMBER more: it bounds rows and bytes.
BLOCK, MEMBER = 1 << 19, 256

_random = np.random.default_rng(20)
_FLIPS = _random.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]
_FACTORS = (_random.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1))[:, None]
_PLACES = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text, its distinct shingles' 64-bit hashes, sorted."""
    words, counts, firsts = hash_words(data, offsets)
    windows = max(0, len(words) - width + 1)
    place = lambda j: _PLACES[j % 64] + np.uint64(j // 64 * 2)
    total = np.zeros(windows, np.uint64)
    for j in range(width):
        total += words[j : j + windows] * place(j)
    total = mix64(total)
    out = []
    for first, n in zip(firsts.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(total[first : first + n - width + 1]))
        elif n:
            own = (words[first : first + n] * np.array([place(j) for j in range(n)], np.uint64)).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(own + np.full(1, 0xD6E8FEB86659FD93, np.uint64) * np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(shingles: np.ndarray, salt: int) -> int:
    """An order-free 64-bit hash of a set, as a signed integer."""
    total = mix64(shingles ^ np.uint64(salt)).sum(dtype=np.uint64) if len(shingles) else np.uint64(0)
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def minima(shingles: np.ndarray) -> np.ndarray:
    """MINIMA minima over the set, each under its own order of 32-bit hashes."""
    h, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        np.minimum(least, ((h[None, at : at + 512] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    return mix64(mix64((rows * _PLACES[None, :ROWS]).sum(axis=1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """The minima's low bits, packed two to a byte."""
    low = (least & np.uint32(15)).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


def equal_minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many low-bit groups are equal, by bit counts over signatures as 64-bit words."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return MINIMA - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int32)


def similarity(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from equal low bits, corrected for chance collisions."""
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def fewest_equal(threshold: float) -> int:
    """The equal groups that a pair at the threshold has but for five standard errors."""
    p = threshold + (1 - threshold) * 2.0**-BITS
    return int(MINIMA * p - 5 * (MINIMA * p * (1 - p)) ** 0.5)


def _sketch(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in (s for b in batches for s in text_slices(b, "text")):
            sets = shingle_sets(*text_bytes(batch.column("text")), width)
            least = [minima(s) for s in sets]
            keys = np.concatenate([band_keys(x) for x in least]) if least else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(sets))), batch.column("doc_id"), batch.column("fp"), pa.array([set_hash(s, 1) for s in sets], pa.int64()), pa.array([set_hash(s, 2) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(x) for x in least], pa.binary()), pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(keys))],
                ["row", "doc_id", "fp", "node", "check", "n", "sig", "bands"],
            )
            row += len(sets)

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in (s for b in batches for s in text_slices(b, "text")):
            sets = shingle_sets(*text_bytes(batch.column("text")), width)
            ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(sets))), batch.column("doc_id"), pa.array([set_hash(s, 1) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(values))], ["row", "doc_id", "node", "shingles"])
            row += len(sets)

    return run


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), SIGNATURE // 8)


def _alike(fewest: int):
    """Pairs (a, b, sig_a, sig_b) that pass the signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = equal_minima(_words(batch.column("sig_a")), _words(batch.column("sig_b"))) >= fewest
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


_GROUP = ["key", "x", "y"]


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of rows sorted by (key, x, y); only one is held at a time."""
    held: pa.Table | None = None
    for batch in (b for b in batches if b.num_rows):
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        key = np.stack([table.column(c).to_numpy() for c in _GROUP])
        cuts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held


def _partners(group: pa.Table, i: int, words: np.ndarray, n: np.ndarray, roots: np.ndarray, block: np.ndarray, across: bool, fewest: int, percent: int) -> np.ndarray:
    """Later members of other components whose sizes and signatures allow a link with member i."""
    others = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1
    others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
    others = others[block[others] != block[i]] if across else others
    return others[equal_minima(words[others], words[i]) >= fewest] if len(others) else others


def _columns(group: pa.Table) -> tuple[np.ndarray, ...]:
    return (_words(group.column("sig").combine_chunks()), *(group.column(c).to_numpy() for c in ("n", "label", "block")))


def _active(fewest: int, percent: int):
    """Rows (key, x, y, block, node, label, n, sig) by group, to those that may link with another component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        rows = 0
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            words, n, label, block = _columns(group)
            across, keep = group.column("x")[0] != group.column("y")[0], np.zeros(group.num_rows, bool)
            for i in range(group.num_rows):
                found = _partners(group, i, words, n, label, block, across, fewest, percent)
                keep[found] = True
                keep[i] |= len(found) > 0
            if keep.any():
                kept.append(group.filter(pa.array(keep)))
                rows += kept[-1].num_rows
            if rows > 2000:
                yield from pa.concat_tables(kept).combine_chunks().to_batches()
                kept, rows = [], 0
        if kept:
            yield from pa.concat_tables(kept).combine_chunks().to_batches()

    return run


def _join_components(fewest: int, percent: int):
    """Rows with ``shingles`` by group, to links (a, b) of the labels of its components: a spanning forest, on full sets."""

    def links(group: pa.Table) -> list[tuple[int, int]]:
        words, n, label, block = _columns(group)
        across, node, found = group.column("x")[0] != group.column("y")[0], group.column("node").to_numpy(), []
        lists = group.column("shingles").combine_chunks()
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        roots = label.copy()
        for i in range(len(node)):
            others = _partners(group, i, words, n, roots, block, across, fewest, percent)
            if not len(others):
                continue
            own = np.sort(values[at[i] : at[i + 1]])
            lengths = at[others + 1] - at[others]
            ends = np.cumsum(lengths)
            theirs = values[np.arange(ends[-1]) + np.repeat(at[others] - ends + lengths, lengths)]
            place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            common = np.add.reduceat((own[place] == theirs).astype(np.int64), ends - lengths)
            linked = others[100 * common >= percent * (lengths + len(own) - common)]
            for j in linked[np.argsort(linked)]:
                if roots[i] != roots[j]:
                    found.append((int(min(label[i], label[j])), int(max(label[i], label[j]))))
                    roots[roots == roots[j]] = roots[i]
        return found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if found := links(group) if group.num_rows > 1 else []:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def dealt_members(members: DataFrame, by_bucket) -> DataFrame:
    """Members (key, node, label, n) of buckets that hold several labels, once for each pair of blocks (x, y) that their ``block`` is in.

    A bucket of one block is one group.  In a larger one, blocks of its largest component have
    negative numbers and meet the blocks of the others, which meet each other too: every two
    members of different components meet, those of the largest don't meet each other.
    ``by_bucket`` joins rows with a table of one row a key.
    """
    weight = (F.col("n") + MEMBER).alias("weight")
    parts = members.groupBy("key", "label").agg(F.sum(weight).alias("weight"))
    sums = parts.groupBy("key").agg(F.max(F.struct("weight", "label")).alias("main"), F.sum("weight").alias("size"), F.count(F.lit(1)).alias("labels"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = sums.where("labels > 1").select("key", F.when(F.col("size") > BLOCK, F.col("main.label")).alias("main"), blocks(F.col("main.weight")).alias("of_main"), F.when(F.col("size") > BLOCK, blocks(F.col("size") - F.col("main.weight"))).otherwise(1).alias("of_others"))
    rows = by_bucket(members, materialize(mixed, "mixed", compact=True))
    inner = F.col("main").isNotNull() & (F.col("label") == F.col("main"))
    hashed = F.xxhash64("node")
    rows = rows.withColumn("block", F.when(inner, -1 - F.pmod(hashed, F.col("of_main"))).otherwise(F.pmod(hashed, F.col("of_others"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("of_others") - 1)
    mains = F.when(F.col("main").isNull(), F.array().cast("array<int>")).otherwise(F.sequence(-F.col("of_main"), F.lit(-1)))
    rows = rows.withColumn("other", F.explode(F.when(inner, others).otherwise(F.concat(mains, others))))
    return rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "label", "n")


class NearDuplicates:
    """The steps of one run; ``run`` gives the result."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs.select("doc_id", "text"), width, percent
        self.fewest = fewest_equal(percent / 100)

    def run(self) -> DataFrame:
        """One row per document: doc_id, fp (the text's hash), n_shingles, group (a node of its component; null without words), component_id, kept."""
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        hashed = self.docs.withColumn("fp", F.xxhash64("text"))
        sketches = materialize(hashed.mapInArrow(_sketch(self.width), f"row bigint, doc_id {kind}, fp bigint, node bigint, check bigint, n bigint, sig binary, bands array<bigint>"), "sketches")
        # One row stands for its set: found by hashed aggregates of numbers, so that signatures are shuffled once and not sorted.
        nodes = sketches.where("n > 0").groupBy("node", "check").agg(F.min("row").alias("row"), F.min("doc_id").alias("min_doc"), F.count(F.lit(1)).alias("copies"))
        self.nodes = materialize(sketches.select("row", "n", "sig", "bands").join(nodes.hint("shuffle_hash"), "row").drop("row", "check"), "nodes")
        self.many = self.nodes.count()
        links = self._labels()
        classes = self.nodes.select("node", "min_doc", "copies")
        if links is None:
            classes = classes.select("node", "copies", F.col("node").alias("group"), F.col("min_doc").alias("component_id"))
        else:
            labelled = materialize(classes.join(links, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label"), "labelled", compact=True)
            least = labelled.groupBy("group").agg(F.min("min_doc").alias("component_id"), F.count(F.lit(1)).alias("members"))
            least = materialize(least, "least", compact=True)
            classes = join_classes(labelled.select("node", "copies", "group"), least, "group", "members", self.many).select("node", "copies", "group", "component_id")
        classes = materialize(classes, "classes", compact=True)
        rows = sketches.select("doc_id", "fp", "node", F.col("n").alias("n_shingles"))
        columns = ["doc_id", "fp", "n_shingles", "group", "component_id"]
        joined = join_classes(rows.where("n_shingles > 0"), classes, "node", "copies", sketches.count()).select(*columns)
        empty = rows.where("n_shingles = 0").select("doc_id", "fp", "n_shingles", F.lit(None).cast("bigint").alias("group"), F.col("doc_id").alias("component_id"))
        return joined.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def _labels(self) -> DataFrame | None:
        """(node, label) of the nodes that have links."""
        banded = self.nodes.select("node", F.explode("bands").alias("key"))
        maps, bits = duplicate_bitmap(banded, "key", max(1, self.many * BANDS))
        shared = materialize(in_filter(banded, "key", materialize(maps, "shared", compact=True), bits), "suspects", compact=True)
        sizes = materialize(shared.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes", compact=True)
        self.sized = sizes
        self.total = shared.count()
        self.buckets = materialize(self._by_bucket(shared, sizes), "buckets", compact=True)
        discard(shared)
        if self.buckets.isEmpty():
            return None
        first = materialize(components(self._confirm(self._hub_pairs())), "first", compact=True)
        # Links that join components are links of their labels: far fewer than nodes.
        second = components(self._joining_links(first))
        both = first.unionByName(second.join(first, "node", "left_anti").select("node", F.col("node").alias("label")))
        return both.join(second.toDF("label", "joined"), "label", "left").select("node", F.coalesce("joined", "label").alias("label"))

    def _by_bucket(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Inner join by key with a row a bucket, that has its size m; a bucket may hold most rows."""
        return join_classes(rows, classes, "key", "m", self.total).where("m is not null")

    def _hub_pairs(self) -> DataFrame:
        """Each member with its bucket's hub, if their signatures are alike."""
        degrees = self.buckets.groupBy("node").agg(F.sum("m").alias("degree"))
        tops = self.buckets.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top"), F.max("m").alias("m"))
        hubs = materialize(tops.select("key", F.col("top.node").alias("hub"), "m"), "hubs", compact=True)
        met = self._by_bucket(self.buckets.drop("m"), hubs).where("node != hub")
        pairs = materialize(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "met", compact=True)
        sigs, both = self.nodes.select("node", "sig", "n"), pairs
        for side in "ab":
            both = salted_join(both, sigs.toDF(side, f"sig_{side}", f"n_{side}"), side, pairs)
        fits = F.expr(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        return materialize(both.where(fits).select("a", "b", "sig_a", "sig_b").mapInArrow(_alike(self.fewest), "a bigint, b bigint"), "pairs", compact=True)

    def _joining_links(self, labels: DataFrame) -> DataFrame:
        """Links (a, b) of components, by label, in buckets that hold several."""
        members = self.buckets.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        members = materialize(members.join(self.nodes.select("node", "n"), "node"), "members", compact=True)
        dealt = dealt_members(members, lambda rows, buckets: self._by_bucket(rows, buckets.join(self.sized, "key")).drop("m"))
        columns = [*_GROUP, "block", "node", "label", "n", "sig"]
        rows = dealt.join(self.nodes.select("node", "sig"), "node").select(*columns)
        schema = "key bigint, x int, y int, block int, node bigint, label bigint, n bigint, sig binary"
        active = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_active(self.fewest, self.percent), schema)
        active = materialize(active, "active", compact=True)
        full = active.join(self._sets(active.select("node")), "node").select(*columns, "shingles")
        found = full.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_join_components(self.fewest, self.percent), "a bigint, b bigint")
        return materialize(found.distinct(), "joining", compact=True)

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """node, shingles: full sets, read again from the text of one document each."""
        wanted = nodes.distinct().join(self.nodes.select("node", F.col("min_doc").alias("doc_id")), "node")
        wanted = materialize(wanted, "wanted", compact=True)
        bits = filter_bits(wanted.count())
        keys = wanted.select(F.xxhash64("doc_id").alias("h"))
        near = in_filter(self.docs.withColumn("h", F.xxhash64("doc_id")), "h", bit_filter(keys, "h", bits), bits)
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        sets = near.select("doc_id", "text").mapInArrow(_sets(self.width), f"row bigint, doc_id {kind}, node bigint, shingles array<bigint>")
        wanted = wanted.withColumnsRenamed({"node": "_node", "doc_id": "_doc"}).hint("shuffle_hash")
        sets = sets.join(wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").drop("doc_id")
        sets = materialize(sets, "sets")
        if sets.count() > sets.select("node").distinct().count():  # whole rows are repeated
            first = sets.groupBy("node").agg(F.min("row").alias("row")).select("row").hint("shuffle_hash")
            sets = materialize(sets.join(first, "row", "left_semi"), "sets")
        return sets.drop("row")

    def _confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough, by whole numbers."""
        sets = self._sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
        both = pairs
        for side in "ba":
            both = salted_join(both, sets.toDF(side, f"set_{side}"), side, pairs)
        common = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("bigint").alias("i"), (F.size("set_a") + F.size("set_b")).cast("bigint").alias("s"))
        return materialize(common.where(F.expr(f"100 * i >= {self.percent} * (s - i)")).select("a", "b"), "confirmed", compact=True)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: its set's size, the least doc_id it is linked to, and whether that is its own."""
    return NearDuplicates(docs, width, percent).run().drop("fp", "group")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, columns unchanged, of which each group of near-duplicates keeps one.

    It is a row of the least doc_id; of several such rows one of the text with the least hash.
    """
    found = materialize(NearDuplicates(docs, width, percent).run().select(F.struct("doc_id", "fp").alias("key"), "group", "kept", F.col("n_shingles").alias("n")), "near")
    kept = found.where("kept and n > 0")
    groups = kept.groupBy("group").agg(F.min("key.fp").alias("fp"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = materialize(kept.join(groups, "group").groupBy("key", (F.col("key.fp") != F.col("fp")).alias("goes")).agg(F.count(F.lit(1)).alias("rows")), "several", compact=True)
    dropped = found.where("not kept").select("key").unionByName(several.where("goes").select("key"))
    return drop_rows(docs, F.struct("doc_id", F.xxhash64("text").alias("fp")), dropped, several.where("not goes and rows > 1").select("key"))
