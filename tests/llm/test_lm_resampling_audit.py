import cProfile
import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, lm_scoring, resampling


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --------------------------------------------------------------------------
# Importance resampling
# --------------------------------------------------------------------------


def brute_features(text, buckets=10_000):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return len(words), [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def test_features(texts):
    odd = ["x" * 300 + " y " + "z" * 200 + " " + "w" * 64 + " " + "v" * 65 + " a", "a b", "A-b_c", "x" * 100, "0 1\x7f2", "end", None, ""]
    for given in ([t for _, t in texts] + odd, odd[::-1], [None], []):
        at, owner, words = resampling.features(pa.array(given, pa.string()))
        for i, text in enumerate(given):
            n, want = brute_features(text)
            assert words[i] == n and sorted(at[owner == i].tolist()) == sorted(want)


def brute_resample(rows, target, percent=25, least=20, seed=7):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(brute_features(text)[1])
    for text in target:
        t.update(brute_features(text)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * (n + 10000) / (float(s[b] + 1) * (m + 10000)))) for b in s}
    out = []
    for doc_id, text in rows:
        words, own = brute_features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = [(*r[:4], k) for k, r in enumerate(able[: len(able) * percent // 100], 1)]
    return Counter(drawn + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in out if not r[4]])


@pytest.mark.parametrize("percent", [25, 100])
def test_resample(spark, docs, percent):
    target = [None, "the quick brown fox 3", "dog3 while4 seven", ""]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "a null id with words " * 6)], "doc_id bigint, text string"))
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = resampling.resample(rows, benchmark, percent=percent).collect()
    assert Counter(map(tuple, got)) == brute_resample([tuple(r) for r in rows.collect()], target, percent)
    assert Counter(map(tuple, resampling.resample(rows, benchmark, percent=percent).collect())) == Counter(map(tuple, got))


def test_resample_empty_tables_and_columns(docs, empty):
    assert resampling.resample(empty, empty).collect() == []
    assert resampling.resample(docs, empty).count() == docs.count()
    drawn = resampling.drawn_documents(docs, empty, percent=50)
    assert drawn.columns == docs.columns
    ids = {r.doc_id for r in resampling.resample(docs, empty, percent=50).collect() if r["rank"]}
    assert {r.doc_id for r in drawn.collect()} == ids


def test_vectors_meet_in_a_tree(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('w', id % 7, ' common') as text").repartition(70)
    counts = resampling.bucket_counts(docs)
    assert counts.sum() == 15_000 and counts[zlib.crc32(b"common") % 10_000] >= 5000


# --------------------------------------------------------------------------
# Language-model scores
# --------------------------------------------------------------------------


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def level_value(count):
    if not count:
        return 0.0
    level = max(i for i, t in enumerate(lm_scoring.THRESHOLDS.tolist()) if t <= count)
    least, more = lm_scoring.THRESHOLDS[level : level + 2].tolist()
    return (least + more - 1) / 2


def brute_scores(rows, order, strength=500.0):
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    grams = [Counter() for _ in range(order + 1)]
    for i, text in rows:
        if not held[i]:
            tokens = ["", *words_of(text), ""]  # the end stands before the first word
            for n in range(1, order + 1):
                grams[n].update(tuple(tokens[a : a + n]) for a in range(1 if n == 1 else 0, len(tokens) - n + 1))
    total, kinds = sum(grams[1].values()), len(grams[1])
    out = []
    for i, text in rows:
        tokens, base, score = ["", *words_of(text), ""], 0.0, 0.0
        for at in range(1, len(tokens)):
            base += math.log10((grams[1][(tokens[at],)] + 1) / (total + kinds + 1))
            counts = level_value(grams[1][(tokens[at],)])
            p, before = (counts + 1) / (total + kinds + 1), counts
            for n in range(2, min(order, at + 1) + 1):
                context = level_value(grams[n - 1][tuple(tokens[at - n + 1 : at])])
                own = min(level_value(grams[n][tuple(tokens[at - n + 1 : at + 1])]), context, before)
                p, before = (own + strength * p) / (context + strength), own
            score += math.log10(p)
        known = sum(grams[1][(t,)] > 0 for t in tokens[1:])
        out.append((i, held[i], len(tokens) - 1, known, total, base, score))
    return out


@pytest.mark.parametrize("order,most_bytes", [(2, 1 << 20), (2, 0), (1, 1 << 20), (3, 1 << 20), (3, 0)])
def test_scores(spark, docs, order, most_bytes):
    """With 40 bits an entry hardly any probe hits falsely: scores are those of the quantised counts, either way."""
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "a null id")], "doc_id bigint, text string"))
    got = lm_scoring.score_documents(rows, lm_scoring.every_seventh(), order=order, bits=40, most_bytes=most_bytes).collect()
    want = brute_scores([tuple(r) for r in rows.collect()], order)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-9)
        assert a[6] == pytest.approx(b[6], abs=0.002 * b[2])


def test_both_ways_score_alike(docs):
    near = [{(r.doc_id, r.score) for r in lm_scoring.score_documents(docs, lm_scoring.every_seventh(), most_bytes=n).collect()} for n in (1 << 20, 0)]
    assert near[0] == near[1]


def test_ngrams_meet_their_owners_once(docs, monkeypatch):
    """Without a broadcast filter, too, chunks send once and are answered at once: nothing asks again."""
    made, write = [], lm_scoring.materialize
    monkeypatch.setattr(lm_scoring, "materialize", lambda df, name, **options: made.append(name) or write(df, name, **options))
    assert lm_scoring.score_documents(docs, lm_scoring.every_seventh(), most_bytes=0).count() == docs.count()
    assert len(made) == 2


def chunk_of(n):
    """A chunk of n tokens in one document, as a batch."""
    words = np.sort(np.random.default_rng(2).choice(1 << 62, n, replace=False).astype(np.uint64) * np.uint64(4))
    places = lm_scoring.pack_places(np.arange(n))
    code = lm_scoring.encode_runs(words, np.array([n]), lm_scoring._shift(n, 64))
    return pa.RecordBatch.from_pydict({"chunk": [0], "doc_ids": [[1]], "held": [[False]], "sizes": [[n]], "n_tokens": [n], "n_words": [n], "tokens": [places], "ranks": [places], **code})


def test_messages_cost_no_calls():
    """What a chunk's messages cost doesn't grow with the number of owners: no code runs for each of them."""
    batch, calls = chunk_of(30_000), []
    for tokens in (1, 1 << 34):
        layout = lm_scoring.Layout(2, 52, tokens, tokens, tokens // 30_000)
        profile = cProfile.Profile()
        sent = profile.runcall(list, lm_scoring._send(layout, True)(iter([batch])))
        calls.append(sum(c.callcount for c in profile.getstats()))
        for message, wide in zip(sent, layout.wide, strict=True):
            order = message["order"][0].as_py()
            keys = lm_scoring.decode_runs(message, message["n"].to_numpy(), layout.shift[order - 1])
            keys |= np.repeat(message["owner"].to_numpy().astype(np.uint64) << np.uint64(layout.span[order - 1]), message["n"].to_numpy())
            chunk = lm_scoring.Chunk(batch.to_pylist()[0])
            want = chunk.words if order == 1 else np.sort(next(g[r] for _, g, r in chunk.grams(2)) >> np.uint64(64 - wide))
            assert (keys == want).all() and len(keys) > 29_000
    assert sent[1].num_rows > 5_000 and calls[1] < 2 * calls[0]


def test_codes_round_trip():
    rng = np.random.default_rng(3)
    for sizes in ([1], [1, 1], [3, 1, 4000], [1, 700, 2, 1]):
        for span in (6, 26, 37, 58, 63):
            keys = [np.sort(rng.integers(0, 1 << span, n, dtype=np.uint64)) for n in sizes]
            for shift in {0 if span == 6 else span - 12, max(0, span - 10), span, min(span, 56)}:
                columns = pa.table(lm_scoring.encode_runs(np.concatenate(keys), np.array(sizes), shift))
                assert (lm_scoring.decode_runs(columns, np.array(sizes), shift) == np.concatenate(keys)).all()
        counts = rng.choice([0, 1, 254, 255, 256, 10**12], sum(sizes))
        assert (lm_scoring.decode_counts(pa.table(lm_scoring.encode_counts(counts, np.array(sizes)))) == counts).all()


def test_known_levels_need_no_probes():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 40, 20_000, dtype=np.uint64))
    levels = lm_scoring.quantised((rng.pareto(1.0, len(keys)) + 0.5).astype(np.int64))
    data = np.frombuffer(lm_scoring.block(keys[levels > 0], levels[levels > 0]), np.uint8)
    whole, zero = np.full(len(keys), 8 * len(data), np.uint64), np.zeros(len(keys), np.uint64)
    assert (levels == 0).any() and (lm_scoring.probe_levels(data, whole, zero, keys, levels) == lm_scoring.probe_levels(data, whole, zero, keys)).all()


def test_nothing_to_learn_from(docs, empty):
    assert lm_scoring.score_documents(empty, lm_scoring.every_seventh()).collect() == []
    rows = lm_scoring.score_documents(docs, F.lit(True)).collect()
    assert len(rows) == docs.count()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}


def test_filter_holds_levels():
    """Nothing that was put in is missed; false hits are about as rare as the filter's size says."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 50_000, dtype=np.uint64))
    levels = lm_scoring.quantised((rng.pareto(1.0, len(keys)) + 1).astype(np.int64))
    data = np.frombuffer(lm_scoring.block(keys, levels), np.uint8)
    look = lambda k: lm_scoring.probe_levels(data, np.full(len(k), 8 * len(data), np.uint64), np.zeros(len(k), np.uint64), k)
    found = look(keys)
    assert (found >= levels).all() and (found > levels).mean() < 0.04
    other = rng.integers(1 << 40, 1 << 41, 50_000, dtype=np.uint64)
    assert (look(other) > 0).mean() < 0.04


def test_levels_and_values():
    counts = np.array([0, 1, 2, 3, 4, 5, 6, 10**9, 2**61])
    levels = lm_scoring.quantised(counts)
    assert levels[0] == 0 and (np.diff(levels.astype(int)) >= 0).all() and levels[1] == 1
    values = lm_scoring.VALUES[levels]
    assert values[1] == 1 and (np.abs(values[1:] - counts[1:]) <= 0.5 * counts[1:]).all()


def test_places_round_trip():
    for places in (np.zeros(0, np.int64), np.array([0, 1, 70_000, 2**31]), np.arange(1000)):
        assert (lm_scoring.unpack_places(lm_scoring.pack_places(places), len(places)) == places).all()


def test_model_beats_words_alone(spark):
    """On held-out documents of a corpus with an order of words."""
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") * 7 + k) % 5) for k in range(40)])
    docs = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = [r for r in lm_scoring.score_documents(docs, lm_scoring.every_seventh(), strength=5.0).collect() if r.held_out]
    assert rows and all(r.score > 0.6 * r.base_score for r in rows)


# --------------------------------------------------------------------------
# Filter audit
# --------------------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    failing = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        mine = [(q, x) for d, q, x in labels if d is not None and d == i]
        failing.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out = Counter()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for part in {p for p, *_ in failing}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                n = dict.fromkeys(names, 0)
                for p, fails, good, toxic in failing:
                    if p != part:
                        continue
                    earlier, here = bool(fails & set(order[: step - 1])), f in fails
                    n["kept"] += not earlier and not here
                    n["removed"] += here and not earlier
                    n["redundant"] += here and earlier
                    n["unique_fails"] += fails == {f}
                    n["good_lost"] += here and not earlier and good
                    n["toxic_lost"] += here and not earlier and toxic
                out[(part, "".join(order), step)] = tuple(n.values())
    removed = Counter()
    for (part, order, step), n in out.items():
        removed[(part, order[step - 1])] += n[1]
    return {k: (*n, removed[(k[0], k[1][k[2] - 1])]) for k, n in out.items()}


def test_audit(spark, docs):
    more = spark.createDataFrame(
        [(100, "Some $ sign " * 60, "en"), (101, "word " * 150, "fr"), (102, " ".join(f"w{i}" for i in range(150)), "fr"), (99, "word " * 150, None), (None, "word " * 150, "fr"), (103, "ABC DEF", "fr")],
        "doc_id bigint, text string, lang string",
    )
    rows = docs.select("doc_id", "text", "lang").union(more).repartition(3)
    labels = [(100, 1, 0), (100, 0, 1), (101, None, 1), (103, 1, None), (5, 1, 1), (None, 1, 1), (777, 1, 1)]
    found = filter_audit.audit_filters(rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    want = brute_audit([tuple(r) for r in rows.collect()], labels)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == want and len(found) == len(want)


def test_audit_empty_tables(spark, docs, empty):
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(empty, no_labels).collect() == []
    assert filter_audit.audit_filters(docs, no_labels).agg(F.sum("good_lost") + F.sum("toxic_lost")).head()[0] == 0


def test_orders_are_bounded(spark):
    assert filter_audit.all_orders(spark, list("ABC")).count() == 6
    with pytest.raises(ValueError):
        filter_audit.all_orders(spark, list("ABCDEFG"))
