"""Operator 4: language identification by averaged hashed subword embeddings.

Subwords are byte n-grams of ORDERS within words, boundaries included, hashed to
BUCKETS rows of an embedding table; a text is the average of its rows, classified by
a linear softmax.  Table and softmax are learned together by stochastic gradient
descent in numpy, on a bounded sample.  As the classifier is linear in the average,
a fitted model keeps each bucket's logits.

A temperature fitted on documents left out of the descent calibrates the score; the
rejection level is the highest, at most one half, that rejects no more than
REJECTED of the right answers there.  A text that is null or has no letter is
``und``.  Null lang is never learned from.  All languages are learned, from a bounded
sample: PER_LANGUAGE documents and MOST_BYTES of text of each (fewer where languages
are so many that they share ``sampling.MOST_ROWS``); a text longer than that is never
learned from.  Texts of any length are predicted whole.  Equal texts get equal answers;
of languages that tie, the first by code point is given; repeated rows stay; with
nothing to learn from, all is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_bytes, text_slices
from tessera.llm.sampling import held_out, sample_texts

ORDERS, BUCKETS, DIMENSIONS = (2, 3, 4), 1 << 16, 16
#: Documents and bytes of text of each language to learn from; passes over them; first step; share of right answers that may be rejected.
PER_LANGUAGE, MOST_BYTES, EPOCHS, STEP, REJECTED = 400, 8 << 20, 6, 4.0, 0.001
UNKNOWN = "und"

#: Bytes that subwords keep: letters and all of non-ASCII; others part words.
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, and the text that each belongs to."""
    spaced = np.full(len(data) + len(offsets), 32, np.uint8)  # a boundary before each text and after the last
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    spaced[np.arange(len(data)) + owner + 1] = _KEEP[data]
    doc = np.repeat(np.arange(len(offsets), dtype=np.int32), np.append(np.diff(offsets) + 1, 1))
    code, blank = spaced.astype(np.uint32), spaced == 32
    found, of = [], []
    for n in range(2, max(ORDERS) + 1):
        last = len(spaced) - n + 1
        if last <= 0:
            break
        code = code[:last] | spaced[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1))
        if n not in ORDERS:
            continue
        inner = np.zeros(last, bool)
        for j in range(1, n - 1):
            inner |= blank[j : j + last]
        at = np.flatnonzero(~inner & ~(blank[:last] & blank[n - 1 :][:last]))
        mixed = (code[at] ^ np.uint32(n * 0x1000193)) * np.uint32(0x9E3779B1)
        found.append(((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        of.append(np.minimum(doc[at], len(offsets) - 2))
    return (np.concatenate(found), np.concatenate(of)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


@dataclass
class LanguageModel:
    """Learned languages, each bucket's logits, the bias, the temperature and the rejection level."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Uncalibrated logits of each text."""
        data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
        buckets, of = subwords(data, offsets)
        total = np.zeros((len(texts), len(self.languages)))
        n = np.maximum(1, np.bincount(of, minlength=len(texts)))
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(of, self.logits[buckets, k], len(texts))
        return total / n[:, None] + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language's index and its calibrated probability."""
        p = _softmax(self.scores(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    """Fit on whole texts and, so that short texts are known too, on one line of each."""
    languages = sorted(set(labels))
    rng, target = np.random.default_rng(seed), np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(texts))
    learn, check = order[len(order) // 5 :], order[: len(order) // 5]
    samples = []
    for i in learn:
        lines = [x for x in texts[i].split("\n") if x]
        for text in (texts[i], lines[rng.integers(len(lines))] if lines else ""):
            buckets, _ = subwords(*text_bytes(pa.array([text.lower()])))
            if len(buckets):
                samples.append((*np.unique(buckets, return_counts=True), len(buckets), target[i]))
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * max(1, len(samples)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            buckets, counts, n, y = samples[k]
            share = (counts / n).astype(np.float32)
            mean = share @ table[buckets]
            error = _softmax(mean @ weights + bias)
            error[y] -= 1
            rate = np.float32(STEP * (1 - done / steps))
            table[buckets] -= rate * share[:, None] * (weights @ error)[None, :]
            weights -= rate * 0.25 * np.outer(mean, error)
            bias -= rate * 0.01 * error
            done += 1
    model = LanguageModel(languages, table @ weights, bias)
    _calibrate(model, [texts[i] for i in check], target[check])
    return model


def _calibrate(model: LanguageModel, texts: list[str], target: np.ndarray) -> None:
    if not texts:
        return
    logits = model.scores(pa.array(texts, pa.string()))
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.2, 20, 60), key=loss))
    p = _softmax(logits / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == target])
    model.reject = float(min(0.5, right[int(REJECTED * len(right))])) if len(right) else 0.0


def learn(docs: DataFrame) -> LanguageModel | None:
    """Fit on a bounded sample of each language's whole documents."""
    labelled = docs.where("text is not null").groupBy("doc_id").agg(F.max("lang").alias("label"))
    texts, labels = sample_texts(docs, labelled, PER_LANGUAGE, MOST_BYTES)
    return fit(texts, labels) if texts else None


def _apply(model: LanguageModel | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b, "text")):
            lettered = batch.column("_lettered").to_numpy(zero_copy_only=False).astype(bool)
            names, scores, rejected = np.full(len(lettered), UNKNOWN, object), np.zeros(len(lettered)), np.ones(len(lettered), bool)
            if model and len(lettered):
                best, p = model.predict(batch.column("text"))
                names[lettered], scores[lettered] = np.array(model.languages, object)[best[lettered]], p[lettered]
                rejected = ~lettered | (scores < model.reject)
            kept = [batch.column(c) for c in batch.schema.names if c != "_lettered"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], [*(c for c in batch.schema.names if c != "_lettered"), "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Adds lang_pred, score and rejected to rows with a text column."""
    rows = docs.withColumn("_lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(_apply(model), f"{schema}, lang_pred string, score double, rejected boolean")


def identify_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its language by a model that learned from four fifths of the labelled ones."""
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def _keep(model: LanguageModel | None):
    """Rows of one struct column that has a text, without those that the model rejects."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field("text"), batch.column("_lettered")], ["row", "text", "_lettered"])
            for cut in text_slices(rows, "text"):
                keep = cut.column("_lettered").to_numpy(zero_copy_only=False).astype(bool)
                if model and keep.any():
                    keep &= model.predict(cut.column("text"))[1] >= model.reject
                yield cut.select(["row"]).filter(pa.array(keep if model else np.zeros(len(keep), bool)))

    return run


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose language the model doesn't reject."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct("*").alias("row"), lettered.alias("_lettered"))
    return rows.mapInArrow(_keep(learn(docs)), f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
