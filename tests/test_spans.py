import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import spans as N

WORDS = ["ab", "abc", "é", "日本", "x", "the", "quick", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.7 else "") for _ in range(n))


def cut(rng, source, n):
    at = rng.randrange(max(1, len(source) - n))
    return source[at : at + n]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    sources = [(i, text(rng, rng.randrange(1, 120))) for i in range(60)] + [(100, None), (101, ""), (102, "a" * 5000), (103, "common passage of some length, that many hold " * 3)]
    sources += [(200 + i, f"{i} common passage of some length, that many hold, and then it goes on and on {i}") for i in range(40)]
    spans = [cut(rng, rng.choice(sources[:60])[1], n) for n in (1, 2, 3, 4, 7, 19, 20, 25, 63, 64, 90, 200) for _ in range(12)]
    spans += [s[:-1] + "#" for s in spans[50:90]] + ["common passage of some length, that many hold", "a" * 30, "a" * 100, "a" * 5001, "é", "日", "\n", " ", "not there at all, none of it"]
    return sources, list(enumerate(spans)) + [(9000, None), (9001, "")]


def test_occurrences_like_a_loop(spark, corpus):
    sources, spans = corpus
    got = N.occurrences(spark.createDataFrame(spans, "span_id int, span string"), spark.createDataFrame(sources, "id bigint, text string").repartition(3)).collect()
    want = {(k, i) for k, s in spans if s for i, t in sources if t and s in t}
    assert len(got) == len(want) and {(r.span_id, r.id) for r in got} == want


def test_first_and_last_like_a_loop(spark, corpus):
    sources, spans = corpus
    got = {r.span_id: (r.first, r.last) for r in N.first_and_last(spark.createDataFrame(spans, "span_id int, span string"), spark.createDataFrame(sources, "id bigint, text string").repartition(3)).collect()}
    held = {k: {i for i, t in sources if t and s in t} for k, s in spans if s}
    assert set(got) == {k for k, ids in held.items() if ids}
    for k, (a, b) in got.items():
        assert a in held[k] and b in held[k] and (a != b) == (len(held[k]) > 1)


def test_kept_windows_are_those_of_any_span():
    """Every window that a span keeps is kept by each text that holds it."""
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    for least, width in N.TIERS:
        _, every = N.winnowed(raw, np.array([0, len(raw)]), width, least)
        for _ in range(40):
            at, n = int(rng.integers(0, 2800)), int(rng.integers(least, least + 60))
            _, own = N.winnowed(raw[at : at + n].copy(), np.array([0, n]), width, least)
            assert len(own) and set(own) <= set(every)
    at, _ = N.winnowed(raw[:10], np.array([0, 4, 4, 10]), 4, 4)
    assert set(at) == {0, 2} and len(N.winnowed(raw[:3], np.array([0, 3]), 4, 4)[0]) == 0


def test_contained_passages(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "zz c d e f g h i"), (3, None), (4, "short")], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, "c d e f g h"), (11, "short"), (12, "b c d e f x y"), (13, None), (14, " ")], "item_id bigint, text string")
    assert sorted(map(tuple, N.contained(docs, items).collect())) == [(1, 10), (2, 10), (4, 11)]
    assert N.contained(docs, items.where("false")).collect() == [] and N.contained(docs.where("false"), items).collect() == []


def test_quotes_and_copied_lines(spark):
    line = "A line of more than one hundred and twenty characters that somebody has written down once and that others may have copied later on, é."
    docs = [(1, f"  {line} \nshort `{line[5:40]}` `{line[:19]}` `made up, not to be found`"), (2, line), (3, f"x {line[10:]} y\n{line[3:]}"), (4, None), (5, "")]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    quotes = {r.doc_id: (r.quotes, r.traceable) for r in N.traceable_quotes(rows, rows.where("doc_id > 1").select(F.col("doc_id").alias("id"), "text")).collect()}
    assert quotes == {1: (2, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
    own = {r.doc_id: r.copied for r in N.copied_share(rows, rows.select(F.col("doc_id").alias("id"), "text"), others=True).collect()}
    pieces = {i: [x.strip() for x in (t or "").splitlines() if len(x.strip()) >= 120] for i, t in docs}
    for i, t in docs:
        found = sum(len(p) for p in pieces[i] if any(p in (o or "") for j, o in docs if j != i))
        assert own[i] == pytest.approx(found / max(1, len(t or "")))
    assert own[1] > 0.5 and own[2] == 1.0 and re.search("é", line)
    alone = {r.doc_id: r.copied for r in N.copied_share(rows, spark.createDataFrame([("s", line)], "id string, text string")).collect()}
    assert alone[1] > 0.5 and alone[3] > 0.4 and alone[5] == 0.0


def _pairs_confirmed(monkeypatch, run):
    """How many pairs of a span and a text were compared."""
    from tessera.operators import spans as N

    seen, confirmed = [], N._confirmed
    monkeypatch.setattr(N, "_confirmed", lambda pairs, *more: seen.append(pairs.count()) or confirmed(pairs, *more))
    return run(), sum(seen)


def test_lines_of_one_document_alone_are_not_compared(spark, monkeypatch):
    import random

    from tessera.operators import spans as N

    rng = random.Random(7)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(150)).strip() + "x" * 10
    shared = line()
    rows = [(i, "\n".join([line(), line(), *([shared] if i < 2 else []), *([f"in it {shared} too"] if i == 2 else [])])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, pairs = _pairs_confirmed(monkeypatch, lambda: {r.doc_id: r.copied for r in N.copied_share(docs, docs.withColumnRenamed("doc_id", "id"), others=True).collect()})
    assert [i for i in range(20) if got[i] > 0] == [0, 1] and pairs < 20


def test_a_quote_is_settled_by_one_source(spark, monkeypatch):
    from tessera.operators import spans as N

    said = "the same passage stands in every one of them"
    sources = spark.createDataFrame([(i, f"{i} {said}" if i != 9 else said[:-1]) for i in range(10)], "id long, text string")
    docs = spark.createDataFrame([(1, f"`{said}` and `{said.upper()}`")], "doc_id long, text string")
    got, pairs = _pairs_confirmed(monkeypatch, lambda: N.traceable_quotes(docs, sources).first())
    assert (got.quotes, got.traceable) == (2, 1) and pairs <= 2


def test_windows_that_no_span_has_are_not_shuffled(spark, monkeypatch):
    """Without broadcasts: neither texts nor their windows go anywhere but where short spans may stand."""
    monkeypatch.setattr(N, "SAMPLE", 4, raising=False)
    rnd = random.Random(21)
    texts = [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(300)) for _ in range(400)]
    sources = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(4).cache()
    spans = spark.createDataFrame([(i, texts[i][50 : 50 + n]) for i, n in enumerate((20, 39, 40, 119))] + [(9, "nowhere said in any text")], "span_id bigint, span string")
    store, made = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    stages = lambda: store.stageList(made(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), made())

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        every = stages()
        return {every.apply(i).stageId(): every.apply(i).shuffleWriteBytes() for i in range(every.size())}

    sources.count()
    before = shuffled()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.span_id: (r.first, r.last) for r in N.first_and_last(spans, sources, both=False).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found == {i: (i, i) for i in range(4)}
    assert sum(n for i, n in shuffled().items() if i not in before) < sum(map(len, texts)) / 2


def test_spans_are_found_around_their_windows(spark, monkeypatch):
    """At both ends of texts and of all sizes, one beside another, in letters of several bytes; against all texts."""
    rnd = random.Random(22)
    draw = lambda n: "".join(rnd.choice("abä漢 ") for _ in range(n))
    common = draw(90)
    texts = [draw(rnd.randint(0, 120)) + common * (i % 3) + draw(rnd.randint(0, 120)) for i in range(60)] + ["", common]
    spans = {t[a : a + n] for t in texts[::4] for n in (10, 14, 20, 30, 40, 60, 80, 119) for a in (0, max(0, len(t) - n), len(t) // 2)} | {draw(25), common, common[5:40], common[3:]}
    spans = sorted(s for s in spans if s)
    held = {s: [i for i, t in enumerate(texts) if s in t] for s in spans}
    rows = spark.createDataFrame(list(enumerate(spans)), "span_id bigint, span string")
    sources = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(3)
    for sample in (1, 1 << 12):
        monkeypatch.setattr(N, "SAMPLE", sample)
        for both in (True, False):
            found = {spans[r.span_id]: (r.first, r.last) for r in N.first_and_last(rows, sources, both=both).collect()}
            assert set(found) == {s for s in spans if held[s]}
            for s, (first, last) in found.items():
                assert first in held[s] and last in held[s] and (not both or (first != last) == (len(held[s]) > 1))


def test_a_filter_holds_all_its_keys(spark):
    keys = np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64)
    words = N._filter(spark.createDataFrame([(int(k),) for k in keys[:2000].view(np.int64)], "key bigint")).value
    assert set(range(2000)) <= set(N._may_hold(words, keys).tolist()) and len(N._may_hold(words, keys)) < 2300
    assert len(N._may_hold(N._filter(spark.createDataFrame([], "key bigint")).value, keys)) == 0
