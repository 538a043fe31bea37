"""Operator 6: toxicity by class-conditional Kneser-Ney models.

Each class has a model of a word given the one before it.  Pairs of words are counted
by class; what their discounts leave backs off to the class's model of the word's
spelling: its bytes and end, each given the CONTEXT bytes before it in the word (a
word's begin is padded, so a context there is the whole prefix).  Below its highest
order that one backs off to one interpolated Kneser-Ney model over the continuation
counts of both classes, so a rare expression that neither class knows scores alike in both.

A toxic text is ordinary but for some expressions.  So its likelihood mixes the two
models at each word, SHARE of the toxic one and the rest of the ordinary one.  The log
of that less the ordinary log-likelihood, divided by the number of words, decides: a
logistic curve over it, fitted on documents that the counts haven't seen, gives the
score, one half where both classes are likely alike.

Models learn from a bounded sample of labelled documents: PER_CLASS documents and
MOST_BYTES of text of each class; a text longer than that is never learned from.
Texts of any length are scored whole.  Null and empty texts get the curve's value for
no evidence.  Equal texts get equal scores, so ties stay ties; repeated rows stay; with
nothing to learn from, the score is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, hash_words, mix64, text_bytes, text_slices
from tessera.llm.sampling import held_out, sample_texts

CONTEXT, DISCOUNT = 5, 0.75
#: In a class's own orders, a gram seen once or twice is discounted more: one document's words say little of its class.
ONCE, TWICE = 1.0, 1.5
#: Share of toxic words in a toxic text, that such a text has at least.
SHARE = 0.003
#: Documents and bytes of text of each class to learn from; words whose likelihoods a worker remembers.
PER_CLASS, MOST_BYTES, MOST_WORDS = 3000, 12 << 20, 300_000

#: Letters and digits, lower-cased, and non-ASCII bytes make words; all else parts them.
_KEEP = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)], np.uint8)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts: distinct ones by hash, and each text's words as places among them."""

    hashes: np.ndarray
    spelled: list[bytes]
    places: np.ndarray
    counts: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word with the one before it in its text, and that of the one before; a text's first word has none (0)."""
        own = self.hashes[self.places]
        before = np.append(np.zeros(1, np.uint64), own[:-1])[: len(own)]
        before[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = 0
        return mix64(before * _PAIR + own), before


def words_of(texts: pa.Array) -> Words:
    """Cuts texts into words."""
    data, offsets = text_bytes(texts)
    data = _KEEP[data]
    hashes, counts, _ = hash_words(data, offsets)
    distinct, first, places = np.unique(hashes, return_index=True, return_inverse=True)
    ink = ~WHITE[data]
    edge = np.append(True, ~ink[:-1])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = np.flatnonzero(ink & edge[: len(ink)])
    stops = np.append(np.flatnonzero(~ink), len(data))
    ends = np.minimum(stops[np.searchsorted(stops, begins)], offsets[np.searchsorted(offsets, begins, "right")]) if len(begins) else begins
    raw = data.tobytes()
    return Words(distinct, [raw[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist(), strict=True)], places, counts)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A code for each byte of each word, and one for its end, with the CONTEXT bytes before; and each code's word."""
    joined = np.frombuffer(b"".join(b"\x00" * CONTEXT + w + b"\x01" for w in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(owner)) + CONTEXT * (owner + 1)
    codes = np.zeros(len(at), np.uint64)
    for j in range(CONTEXT + 1):
        codes |= joined[at - j] << np.uint64(8 * j)
    return codes, owner


def _find(table: np.ndarray, codes: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns of a sorted table at codes, 0 where absent."""
    if not len(table):
        return [np.zeros((len(codes), *c.shape[1:])) for c in columns]
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    hit = table[at] == codes
    return [np.where(hit if c.ndim == 1 else hit[:, None], c[at], 0) for c in columns]


def discounted(n: np.ndarray) -> np.ndarray:
    """Counts of a class's own orders after their discounts."""
    return np.where(n == 0, 0.0, n - np.where(n == 1, ONCE, np.where(n == 2, TWICE, 2 * DISCOUNT)))


@dataclass
class Order:
    """A highest order's grams and their contexts, by class (the last axis): discounted counts, and contexts' counts and discounted mass."""

    grams: np.ndarray
    kept: np.ndarray
    contexts: np.ndarray
    sums: np.ndarray
    taken: np.ndarray

    def probability(self, grams: np.ndarray, contexts: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Of both classes, interpolated with ``back``; that alone where a class doesn't know the context."""
        total, taken = _find(self.contexts, contexts, self.sums, self.taken)
        known, out = np.flatnonzero(total.any(axis=1)), back.copy()
        total = total[known]
        (kept,) = _find(self.grams, grams[known], self.kept)
        out[known] = np.where(total > 0, (kept + taken[known] * back[known]) / np.maximum(total, 1), back[known])
        return out


def _order(by_class: list[tuple[np.ndarray, np.ndarray]]) -> Order:
    """From (grams, contexts) of each class, as often as they stand there; without what the discounts leave nothing of."""
    counted, parts = [], []
    for codes, heads in by_class:
        known, first, n = np.unique(codes, return_index=True, return_counts=True)
        counted.append((known, heads[first], n))
    contexts = np.unique(np.concatenate([h for _, h, _ in counted]))
    for _, heads, n in counted:
        at = np.searchsorted(contexts, heads)
        parts.append((np.bincount(at, n, len(contexts)), np.bincount(at, n - discounted(n), len(contexts))))
    grams = np.unique(np.concatenate([g for g, _, _ in counted]))
    kept = np.stack([_find(g, grams, discounted(n))[0] for g, _, n in counted], axis=1)
    sums, taken = (np.stack([p[i] for p in parts], axis=1) for i in (0, 1))
    left, useful = kept.any(axis=1), (sums > taken).any(axis=1)
    return Order(grams[left], kept[left], contexts[useful], sums[useful], taken[useful])


@dataclass
class ToxicityModel:
    """Both classes' orders of pairs and of spelling, the shared orders, and the logistic curve."""

    pairs: Order
    spelling: Order
    lower: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by order: grams, counts, contexts, sums, followers
    alphabet: int
    curve: np.ndarray | None = None

    def shared(self, codes: np.ndarray) -> np.ndarray:
        """The shared model's probability of each gram's last byte, from the lowest order up."""
        p = np.full(len(codes), 1 / self.alphabet)
        for order, (known, counts, contexts, sums, followers) in enumerate(self.lower, 1):
            own = codes & np.uint64((1 << 8 * order) - 1)
            (n,) = _find(known, own, counts)
            total, kinds = _find(contexts, own >> np.uint64(8), sums, followers)
            p = np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(total, 1), p)
        return p

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """log P(word | ordinary) and log P(word | toxic) of each word's spelling."""
        codes, owner = grams(words)
        logs = np.log(self.spelling.probability(codes, codes >> np.uint64(8), np.repeat(self.shared(codes)[:, None], 2, axis=1)))
        return np.stack([np.bincount(owner, logs[:, k], len(words)) for k in (0, 1)], axis=1)

    def ratios(self, words: Words, memory: dict[int, tuple[float, float]]) -> np.ndarray:
        """For each word: log P(word | the one before, toxic) - log P(word | the one before, ordinary)."""
        if len(memory) > MOST_WORDS:
            memory.clear()
        new = [i for i, h in enumerate(words.hashes.tolist()) if h not in memory]
        for at in range(0, len(new), 20_000):
            own = new[at : at + 20_000]
            memory.update(zip(words.hashes[own].tolist(), map(tuple, self.spelled([words.spelled[i] for i in own]).tolist()), strict=True))
        if not len(words.places):
            return np.zeros(0)
        logs = np.array(list(map(memory.__getitem__, words.hashes.tolist())))[words.places]
        p = np.log(self.pairs.probability(*words.pairs(), np.exp(np.maximum(logs, -600))))
        return p[:, 1] - p[:, 0]

    def evidence(self, texts: pa.Array, memory: dict[int, tuple[float, float]]) -> np.ndarray:
        """Each text's toxic log-likelihood less its ordinary one, for a word of its length; 0 without words."""
        words = words_of(texts)
        toxic = np.logaddexp(np.log(1 - SHARE), np.log(SHARE) + self.ratios(words, memory))
        owner = np.repeat(np.arange(len(texts)), words.counts)
        return np.bincount(owner, toxic, len(texts)) / np.maximum(1, words.counts)

    def score(self, texts: pa.Array, memory: dict[int, tuple[float, float]]) -> np.ndarray:
        """Calibrated scores."""
        z = self.curve[0] * self.evidence(texts, memory) + self.curve[1]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _grouped(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of sorted grams, their summed counts and distinct followers."""
    heads = codes >> np.uint64(8)
    firsts = np.flatnonzero(np.append(True, heads[1:] != heads[:-1])) if len(heads) else np.zeros(0, np.int64)
    return heads[firsts], np.add.reduceat(counts, firsts) if len(firsts) else counts, np.diff(np.append(firsts, len(heads)))


def count_models(ordinary: list[str], toxic: list[str]) -> ToxicityModel:
    """Count both classes' pairs and spellings, each once a document, and the shared continuation counts."""
    spelling, pairs = [], []
    for texts in (ordinary, toxic):
        codes, both, heads = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for text in texts:
            words = words_of(pa.array([text], pa.string()))
            if len(words.places):
                codes.append(grams(words.spelled)[0])
                pair, before = words.pairs()
                pair, first = np.unique(pair, return_index=True)
                both.append(pair)
                heads.append(before[first])
        spelled = np.concatenate(codes)
        spelling.append((spelled, spelled >> np.uint64(8)))
        pairs.append((np.concatenate(both), np.concatenate(heads)))
    every = np.unique(np.concatenate([codes for codes, _ in spelling]))
    lower, codes = [], every
    for order in range(CONTEXT, 0, -1):  # a gram counts as often as it has distinct bytes before it
        codes, counts = np.unique(codes & np.uint64((1 << 8 * order) - 1), return_counts=True)
        lower.append((codes, counts, *_grouped(codes, counts)))
    return ToxicityModel(_order(pairs), _order(spelling), lower[::-1], max(2, len(np.unique(every & np.uint64(255)))))


def fit(texts: list[str], labels: list[int], seed: int = 3) -> ToxicityModel | None:
    """Counts from seven tenths of the sample, the curve from the rest."""
    if len(set(labels)) < 2:
        return None
    y = np.array(labels)
    order = np.random.default_rng(seed).permutation(len(texts))
    cut = len(order) * 7 // 10
    model = count_models([texts[i] for i in order[:cut] if not y[i]], [texts[i] for i in order[:cut] if y[i]])
    memory, rest = {}, order[cut:]
    x = np.concatenate([model.evidence(pa.array([texts[i] for i in rest[a : a + 100]], pa.string()), memory) for a in range(0, len(rest), 100)]) if len(rest) else np.zeros(0)
    model.curve = _curve(x, y[rest])
    return model


def _curve(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Slope (0 at least) and bias of a logistic curve, both classes weighing alike, by Newton's method with a small ridge."""
    spread = max(1e-9, float(x.std())) if len(x) else 1.0
    rows, w = np.stack([x / spread, np.ones(len(x))], axis=1), np.zeros(2)
    weight = np.where(t == 1, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum()))
    ridge = np.diag([1e-4, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -50, 50)))
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (weight * (t - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.array([max(0.0, w[0] / spread), w[1]])


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Fit on a bounded sample of each class's whole documents."""
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    texts, marks = sample_texts(docs, marks, PER_CLASS, MOST_BYTES)
    return fit(texts, marks) if texts else None


_memories: dict[int, dict[int, tuple[float, float]]] = {}


def _apply(model: ToxicityModel | None, stamp: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stamp not in _memories:
            _memories.clear()
        memory = _memories.setdefault(stamp, {})
        for batch in (s for b in batches for s in text_slices(b, "text")):
            scores = model.score(batch.column("text"), memory) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its score and whether it counts as toxic."""
    model = learn(docs, labels)
    stamp = hash((model.spelling.grams.tobytes(), model.curve.tobytes())) if model else 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(_apply(model, stamp), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
