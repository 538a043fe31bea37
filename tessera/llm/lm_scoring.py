"""Operator 12: language-model scores from a log-frequency Bloom filter.

1. Texts are cut into chunks of CHUNK bytes, each stored once: its tokens as places in the
   list of its distinct words' 64-bit hashes.  A document's last token is its end, which is
   also what stands before its first word.
2. Chunks send their n-grams, sorted and Golomb-coded, to owners by a prefix of the hash,
   all orders at once.  Owners add up the counts of training documents.  For words they
   answer every chunk with exact counts, from which the unsmoothed base score follows.
3. A count c is quantised to level 1 + floor(log(c) / log(BASE)), and an n-gram enters its
   owner's block of the filter once for each level up to its own, so that frequent ones
   cost a few entries more.  Keys have as many bits as keep two n-grams apart (16 more
   than the number of tokens), blocks BITS bits an entry.
4. An n-gram's level is found by repeated membership probes, level by level until one
   misses; a miss is certain, a false hit has a probability of about two in a hundred.
   A level stands for the mean of its counts.  Each order is smoothed by the one below:
   ``(count + STRENGTH * lower) / (context's count + STRENGTH)``, words by one added to each.

The filter is broadcast if it can't have more than MOST_BYTES (a level is no greater than
its count, so entries are no more than tokens).  Otherwise its blocks stay with their
owners, which probe for every n-gram that a chunk sent and answer with its level: each
n-gram goes to its owner and back once, and nothing that grows passes through the driver.
Both ways give the same levels.

A message is what one chunk sends one owner.  There are chunks times owners of them, which
grows by more than the input, so no code runs for a single one: all messages of a chunk
are coded, and all of an owner decoded, in one piece.

Null text counts as empty: its only token is the end.  A null doc_id counts as held out.
Repeated rows are separate documents, counted and scored each.  A text of any length is
read whole, in one task.  With nothing to learn from, all scores are 0.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_words, materialize, mix64, text_bytes, text_slices
from tessera.llm.exact_dedup import _shift

#: Longest n-gram; bytes of text of a chunk; entries that an owner is meant to hold; bytes that are broadcast at most.
ORDER, CHUNK, OWNER_HOLDS, MOST_BYTES = 2, 4 << 20, 1 << 21, 128 << 20
#: The filter's bits an entry and probes; the counts' base; how many observations the lower order weighs.
BITS, PROBES, BASE, STRENGTH = 8, 5, 1.5, 500.0

END = np.uint64(0xD1B54A32D192ED03)
_PAIR, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF)
#: Large rows: groups and pages are closed as soon as they are full.
_LAYOUT = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def _thresholds() -> np.ndarray:
    """The least count of each level; level 1 begins at 1."""
    found, power = [], 1.0
    while power < 2**62:
        least = int(np.ceil(power - 1e-9))
        if not found or least > found[-1]:
            found.append(least)
        power *= BASE
    return np.array(found, np.int64)


THRESHOLDS = _thresholds()
#: What sets a key's entries apart, by level.
_LEVELS = np.arange(len(THRESHOLDS) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
#: What a level's counts are on average; level 0 is no count.
VALUES = np.append(0.0, np.append((THRESHOLDS[:-1] + THRESHOLDS[1:] - 1) / 2, float(THRESHOLDS[-1])))


def quantised(counts: np.ndarray) -> np.ndarray:
    """Levels of counts."""
    return np.searchsorted(THRESHOLDS, counts, "right").astype(np.uint8)


# --------------------------------------------------------------------------
# Codes
# --------------------------------------------------------------------------

#: The columns of a code of keys.
_CODES = ("unary", "rest", "low")
#: A count of MANY or more stands in ``many``, with eight bytes.
MANY = 255


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes cut into values of these sizes."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins."""
    values = values.cast(pa.large_binary())
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]


def encode_runs(keys: np.ndarray, sizes: np.ndarray, shift: int) -> dict[str, pa.Array]:
    """Golomb-Rice codes of many runs of sorted unsigned integers, none empty, a value for each run.

    ``unary`` are the gaps' quotients, ``rest`` and ``low`` their ``shift`` low bits: what is
    more than whole bytes, and those.
    """
    begins, whole, rest = np.cumsum(sizes) - sizes, shift // 8, shift % 8
    gaps = np.diff(keys, prepend=np.uint64(0))
    gaps[begins] = keys[begins]
    ends = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1)
    before = np.append(0, ends[begins[1:] - 1])
    unary_sizes = (np.append(before[1:], ends[-1:]) - before + 7) // 8
    unary = np.zeros(8 * int(unary_sizes.sum()), np.uint8)
    unary[ends - 1 + np.repeat(8 * (np.cumsum(unary_sizes) - unary_sizes) - before, sizes)] = 1
    rest_sizes = (sizes * rest + 7) // 8
    bits = np.zeros(8 * int(rest_sizes.sum()), np.uint8)
    if rest:
        at, over = np.arange(len(keys)) * rest + np.repeat(8 * (np.cumsum(rest_sizes) - rest_sizes) - begins * rest, sizes), ((gaps >> np.uint64(8 * whole)) & np.uint64((1 << rest) - 1)).astype(np.uint8)
        for b in range(rest):
            bits[at + b] = (over >> (rest - 1 - b)) & 1
    low = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :whole]
    return {"unary": _binary(np.packbits(unary), unary_sizes), "rest": _binary(np.packbits(bits), rest_sizes), "low": _binary(low, sizes * whole)}


def decode_runs(columns: pa.Table | pa.RecordBatch, sizes: np.ndarray, shift: int) -> np.ndarray:
    """All integers of ``encode_runs``, run by run."""
    begins, whole, rest, n = np.cumsum(sizes) - sizes, shift // 8, shift % 8, int(sizes.sum())
    data, starts = _flat(columns["unary"])
    ends = np.flatnonzero(np.unpackbits(data))
    before = np.append(-1, ends[:-1])
    before[begins] = 8 * starts - 1
    gaps = (ends - before - 1).astype(np.uint64) << np.uint64(shift)
    if rest:
        data, starts = _flat(columns["rest"])
        bits, at = np.unpackbits(data), np.arange(n) * rest + np.repeat(8 * starts - begins * rest, sizes)
        over = np.zeros(n, np.uint8)
        for b in range(rest):
            over |= bits[at + b] << (rest - 1 - b)
        gaps |= over.astype(np.uint64) << np.uint64(8 * whole)
    low = np.zeros((n, 8), np.uint8)
    low[:, :whole] = _flat(columns["low"])[0].reshape(n, whole)
    gaps |= low.view("<u8").reshape(-1)
    keys = np.cumsum(gaps, dtype=np.uint64)
    return keys - np.repeat(keys[begins] - gaps[begins], sizes)


def encode_counts(counts: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
    """A byte a count, and those of MANY or more apart."""
    many = counts >= MANY
    return {"counts": _binary(np.minimum(counts, MANY).astype(np.uint8), sizes), "many": _binary(counts[many].astype("<i8").view(np.uint8), 8 * np.add.reduceat(many, np.cumsum(sizes) - sizes, dtype=np.int64))}


def decode_counts(columns: pa.Table | pa.RecordBatch) -> np.ndarray:
    counts = _flat(columns["counts"])[0].astype(np.int64)
    counts[counts == MANY] = np.ascontiguousarray(_flat(columns["many"])[0]).view("<i8")
    return counts


# --------------------------------------------------------------------------
# Chunks
# --------------------------------------------------------------------------


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of some texts, ends included, and tokens of each text."""
    hashes, words, _ = hash_words(*text_bytes(texts))
    tokens = np.full(len(hashes) + len(words), END)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(words + 1) - 1] = False
    tokens[inner] = hashes
    return tokens, words + 1


def pack_places(places: np.ndarray) -> bytes:
    """Places as four planes of bytes, compressed."""
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_places(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _cut(kind: pa.DataType):
    """Documents to chunks.  Places are by frequency, as small numbers pack well; words are stored sorted by hash, with the place of each."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(kind)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("tokens", pa.binary()), ("ranks", pa.binary()), *((code, pa.binary()) for code in _CODES)])

    def chunk(at: int, held: list[tuple]) -> pa.RecordBatch:
        ids, marks = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
        tokens, sizes = (np.concatenate([x[i] for x in held]) for i in (2, 3))
        words, places, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        ranks = np.empty(len(order), np.uint32)
        ranks[order] = np.arange(len(order), dtype=np.uint32)
        row = [[at], [ids.to_pylist()], [marks.to_pylist()], [sizes.tolist()], [len(tokens)], [len(words)], [pack_places(ranks[places])], [pack_places(ranks)]]
        code = encode_runs(words, np.array([len(words)]), _shift(len(words), 64))
        return pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(row, schema, strict=False)), *(code[c] for c in _CODES)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in (s for b in batches for s in text_slices(b, "text")):
            held.append((batch.column("doc_id").cast(kind), batch.column("held"), *tokens_of(batch.column("text"))))
            size += len(text_bytes(batch.column("text"))[0])
            if size >= CHUNK:
                yield chunk(at, held)
                at, held, size = at + 1, [], 0
        if held:
            yield chunk(at, held)

    return run


class Chunk:
    """A chunk's row, unpacked."""

    def __init__(self, row: dict):
        self.at, self.sizes = row["chunk"], np.array(row["sizes"], np.int64)
        self.words = decode_runs(pa.table({c: [row[c]] for c in _CODES}), np.array([row["n_words"]]), _shift(row["n_words"], 64))
        self.where = np.empty(row["n_words"], np.int64)  # by place, the word's position in order of hashes
        self.where[unpack_places(row["ranks"], row["n_words"])] = np.arange(row["n_words"])
        self.tokens = self.where[unpack_places(row["tokens"], row["n_tokens"])]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.learned = ~np.array(row["held"], bool)[self.owner]

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each order from 2: the hash of the n-gram that ends at each token, and whether the document reaches back as far.

        As every document ends in the end, it also stands before the next one's first word.
        """
        own = self.words[self.tokens]
        keys, place = own, np.arange(len(own)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        for n in range(2, order + 1):
            keys = mix64(np.roll(keys, 1) * _PAIR + own)
            yield n, keys, place >= n - 2


# --------------------------------------------------------------------------
# The exchange
# --------------------------------------------------------------------------

_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}

_MESSAGE = "order int, owner int, chunk bigint, n bigint, unary binary, rest binary, low binary, counts binary, many binary"
_MERGED = "order int, owner int, chunk bigint, inserts bigint, tokens bigint, distinct bigint, data binary, counts binary, many binary, levels binary"
_ANSWER = ["order", "owner", "counts", "many", "levels"]


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    fields = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in fields], schema=fields)


class Layout:
    """Bits of keys, as they are sent and in the filter, of owners' numbers and of Rice codes, by order."""

    def __init__(self, orders: int, key_bits: int, tokens: int, words: int, chunks: int):
        self.orders, self.key_bits = range(1, orders + 1), key_bits
        self.owner_bits = [_owner_bits(words if n == 1 else tokens, key_bits) for n in self.orders]
        self.wide = [64 if n == 1 else key_bits for n in self.orders]  # base scores are of whole words
        self.span = [w - o for w, o in zip(self.wide, self.owner_bits, strict=True)]
        self.shift = [_shift((words if n == 1 else tokens) // (max(1, chunks) << self.owner_bits[n - 1]), self.span[n - 1]) for n in self.orders]


def _send(layout: Layout, asked: bool):
    """Chunk side: counts of learned n-grams.

    Words are sent with those of held-out documents, counted 0, as all want an answer; so
    are all n-grams if levels are ``asked``.
    """

    def message(order: int, chunk: Chunk, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """A row for each owner of sorted distinct keys."""
        span = layout.span[order - 1]
        owners = (keys >> np.uint64(span)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        sizes = np.diff(cuts, append=len(keys))
        columns = {"order": np.full(len(cuts), order), "owner": owners[cuts], "chunk": np.full(len(cuts), chunk.at), "n": sizes}
        columns |= encode_runs(keys & np.uint64((1 << span) - 1), sizes, layout.shift[order - 1]) | encode_counts(counts, sizes)
        return _batch(columns, _MESSAGE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            chunk = Chunk(row)
            yield message(1, chunk, chunk.words, np.bincount(chunk.tokens[chunk.learned], minlength=len(chunk.words)))
            for n, grams, reach in chunk.grams(layout.orders[-1]):
                shift = np.uint64(64 - layout.key_bits)
                keys, counts = np.unique(grams[reach & chunk.learned] >> shift, return_counts=True)
                if asked:
                    learned, found = keys, counts
                    keys = np.unique(grams[reach] >> shift, return_counts=True)[0]  # sorts; without counts numpy hashes, which is far slower here
                    counts = np.zeros(len(keys), np.int64)
                    counts[np.searchsorted(keys, learned)] = found
                if len(keys):
                    yield message(n, chunk, keys, counts)

    return run


def _merge(layout: Layout, bits: int, asked: bool):
    """Owner side: one row of its block, or what it holds, and each chunk's answers: counts over all chunks of its words, levels of its n-grams if ``asked``.

    The filter's keys are the first ``key_bits`` of a key.
    """

    def run(table: pa.Table) -> pa.Table:
        order, owner = table["order"][0].as_py(), table["owner"][0].as_py()
        span, sizes = layout.span[order - 1], table["n"].to_numpy().astype(np.int64)
        known, where = np.unique(decode_runs(table, sizes, layout.shift[order - 1]) | np.uint64(owner << span), return_inverse=True)
        total = np.bincount(where, decode_counts(table)).astype(np.int64)
        seen, (short, at) = total > 0, np.unique(known >> np.uint64(layout.wide[order - 1] - layout.key_bits), return_inverse=True)
        levels = quantised(np.bincount(at, total).astype(np.int64))
        data = block(short[levels > 0], levels[levels > 0], bits)
        held = {"order": [order], "owner": [owner], "inserts": [int(levels.sum(dtype=np.int64))], "tokens": [int(total.sum())], "distinct": [int(seen.sum())], "data": [None if asked else data]}
        found = [_batch(held, _MERGED)]
        if asked or order == 1:
            none = _binary(np.zeros(0, np.uint8), np.zeros(len(sizes), np.int64))
            answers = {"order": np.full(len(sizes), order), "owner": np.full(len(sizes), owner), "chunk": table["chunk"].combine_chunks(), "counts": none, "many": none, "levels": none}
            if order == 1:
                answers |= encode_counts(total[where], sizes)
            if asked:
                probed = probe_levels(np.frombuffer(data, np.uint8), np.full(len(short), 8 * len(data), np.uint64), np.zeros(len(short), np.uint64), short, levels)
                answers["levels"] = _binary(probed[at[where]], sizes)
            found.append(_batch(answers, _MERGED))
        return pa.Table.from_batches(found)

    return run


# --------------------------------------------------------------------------
# The filter
# --------------------------------------------------------------------------


def _halves(keys: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix64(keys * _PAIR + _LEVELS[level])
    return mixed >> np.uint64(32), (mixed & _LOW) | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, probe: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    return (((a + np.uint64(probe) * b) & _LOW) * bits) >> np.uint64(32)


def block_bits(inserts: int, bits: int = BITS) -> int:
    """Bits of a block: whole bytes."""
    return -(-inserts * bits // 8) * 8


def block(keys: np.ndarray, levels: np.ndarray, bits: int = BITS) -> bytes:
    """A filter that holds (key, 1), (key, 2) ... up to each key's level."""
    size = block_bits(int(levels.sum(dtype=np.int64)), bits)
    marks = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        a, b = _halves(keys[levels >= level], level)
        for probe in range(PROBES):
            marks[_place(a, b, probe, np.uint64(size))] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def probe_levels(data: np.ndarray, bits: np.ndarray, begin: np.ndarray, keys: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
    """Each key's level in the block of ``bits`` bits that begins at bit ``begin`` (both by key).

    ``held`` are levels up to which keys are known to be in the block, so that these hit.
    """
    levels = np.zeros(len(keys), np.uint8) if held is None else held.copy()
    alive = np.flatnonzero((bits > 0) & (levels < len(THRESHOLDS)))
    while len(alive):
        a, b = _halves(keys[alive], levels[alive] + 1)
        for probe in range(PROBES):
            at = _place(a, b, probe, bits[alive]) + begin[alive]
            hit = (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive, a, b = alive[hit], a[hit], b[hit]
        levels[alive] += 1
        alive = alive[levels[alive] < len(THRESHOLDS)]
    return levels


class LevelFilter:
    """All blocks in one piece: for each order and owner its bits and where they begin."""

    def __init__(self, sizes: dict[tuple[int, int], int], owner_bits: list[int], key_bits: int, data: bytes):
        self.owner_bits, self.key_bits, self.data = owner_bits, key_bits, np.frombuffer(data, np.uint8)
        begin, self.bits, self.begin = 0, [], []
        for order, width in enumerate(owner_bits, 1):
            own = np.array([sizes.get((order, o), 0) for o in range(1 << width)], np.uint64)
            self.bits.append(own)
            self.begin.append(np.uint64(begin) + np.cumsum(own) - own)
            begin += int(own.sum())

    def levels(self, order: int, hashes: np.ndarray) -> np.ndarray:
        keys = hashes >> np.uint64(64 - self.key_bits)
        owner = (keys >> np.uint64(self.key_bits - self.owner_bits[order - 1])).astype(np.int64)
        return probe_levels(self.data, self.bits[order - 1][owner], self.begin[order - 1][owner], keys)


# --------------------------------------------------------------------------
# Scores
# --------------------------------------------------------------------------


def token_probabilities(chunk: Chunk, order: int, strength: float, total: int, look: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The smoothed probability of every token; ``look`` gives the levels of n-grams of an order at some of those in reach, ``total`` is the number of tokens and of distinct ones."""
    counts = VALUES[look(1, chunk.words, np.arange(len(chunk.words)))][chunk.tokens]
    p = (counts + 1) / (total + 1)
    for n, grams, reach in chunk.grams(order):
        context = np.roll(counts, 1)  # of the words before; what is out of reach isn't used
        at = np.flatnonzero(reach & (context > 0) & (counts > 0))
        own = np.zeros(len(p))
        own[at] = np.minimum(VALUES[look(n, grams, at)], np.minimum(context[at], counts[at]))
        p = np.where(reach, (own + strength * p) / (context + strength), p)
        counts = own
    return p


def _score(layout: Layout, strength: float, tokens: int, distinct: int, held, kind: pa.DataType):
    """Scores of a chunk's documents; ``held`` is the broadcast filter, or None where the owners' levels stand in the row."""
    schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    cut = np.uint64(64 - layout.key_bits)

    def broadcast(n: int, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        found, where = np.unique(grams[at], return_inverse=True)
        return held.value.levels(n, found)[where]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["answers"]).to_pylist()):
                chunk, n = Chunk(row), len(row["sizes"])
                answers = pa.Table.from_struct_array(batch.column("answers")[i].values).sort_by([("order", "ascending"), ("owner", "ascending")])
                parts = {k: answers.filter(pc.equal(answers["order"], k)) for k in layout.orders}

                def answered(k: int, grams: np.ndarray, at: np.ndarray, chunk: Chunk = chunk, parts: dict = parts) -> np.ndarray:
                    levels = _flat(parts[k]["levels"])[0]
                    if k == 1:
                        return levels[at]
                    reach = next(r for o, _, r in chunk.grams(k) if o == k)
                    where = np.zeros(len(grams), np.int64)
                    where[reach] = np.unique(grams[reach] >> cut, return_inverse=True)[1]
                    return levels[where[at]]

                counts = decode_counts(parts[1])[chunk.tokens]
                base = np.bincount(chunk.owner, np.log10((counts + 1) / (tokens + distinct + 1)), n)
                known = np.bincount(chunk.owner[counts > 0], minlength=n)
                p = token_probabilities(chunk, layout.orders[-1], strength, tokens + distinct, broadcast if held else answered)
                score = np.bincount(chunk.owner, np.log10(p), n)
                columns = [row["doc_ids"], row["held"], chunk.sizes, known, np.full(n, tokens), base, score]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _owner_bits(entries: int, key_bits: int) -> int:
    """64 owners at least, and as many as hold OWNER_HOLDS entries each."""
    return min(20, key_bits - 1, 6 + (entries // (OWNER_HOLDS << 6)).bit_length())


def score_documents(docs: DataFrame, held_out: Column, order: int = ORDER, strength: float = STRENGTH, bits: int = BITS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document: its tokens, base score and score in log10, by what isn't held out.

    ``held_out`` is a condition over the columns of ``docs``; null counts as held out.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    arrow_kind = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held"), "text")
    columns = f"chunk bigint, doc_ids array<{kind}>, held array<boolean>, sizes array<bigint>, n_tokens bigint, n_words bigint, tokens binary, ranks binary, unary binary, rest binary, low binary"
    chunks = materialize(rows.mapInArrow(_cut(arrow_kind), columns), "chunks", **_LAYOUT)
    size = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("chunks")).head()
    key_bits = min(64, max(32, size.tokens.bit_length() + 16))
    layout = Layout(order, key_bits, size.tokens, size.words, size.chunks)
    asked = order * size.tokens * bits > 8 * most_bytes

    sent = chunks.mapInArrow(_send(layout, asked), _MESSAGE)
    merged = materialize(sent.groupBy("order", "owner").applyInArrow(_merge(layout, bits, asked), _MERGED), "merged", **_LAYOUT)
    blocks = merged.where("chunk is null")
    total = blocks.where("order = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).head()
    held = None
    if not asked:
        built = blocks.where("inserts > 0").select("order", "owner", "inserts", "data").toArrow().sort_by([("order", "ascending"), ("owner", "ascending")])
        sizes = {(o, w): block_bits(i, bits) for o, w, i in zip(*(built[c].to_pylist() for c in ("order", "owner", "inserts")), strict=True)}
        held = spark.sparkContext.broadcast(LevelFilter(sizes, layout.owner_bits, key_bits, _flat(built["data"])[0].tobytes()))
        del built
    # A chunk's answers are as many as its distinct n-grams.
    answers = merged.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct(*_ANSWER)).alias("answers"))
    run = _score(layout, strength, total.tokens, total.distinct, held, arrow_kind)
    return chunks.join(answers.hint("shuffle_hash"), "chunk").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def every_seventh(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 7 is 2."""
    return F.crc32(F.col(doc_id).cast("string")) % 7 == 2
