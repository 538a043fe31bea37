import re
from collections import Counter

import public_tokenizers
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm.mixing import take_mix  # noqa: E402
from tests.llm.test_near_dedup import brute  # noqa: E402
from tests.llm.test_tokens_packing import crc, plain  # noqa: E402


def test_stages(docs):
    """Each stage on all that the one before it kept, against brute force."""
    spark, cols = docs.sparkSession, docs.columns
    rows = docs.dropDuplicates(["doc_id"]).withColumn("lang", docs.lang)
    known = pipeline.known_languages(spark, rows, "").cache()
    assert known.columns == cols and {r.doc_id for r in known.collect()}.isdisjoint({0, 1, 2, 15, 16, 17})
    single = pipeline.without_copies(spark, known, "").cache()
    keep = {}
    for r in known.collect():
        keep[r.text] = max(keep.get(r.text, -1), r.doc_id)
    assert single.columns == cols and {r.doc_id for r in single.collect()} == set(keep.values())
    apart = pipeline.without_near_copies(spark, single, "").cache()
    want = brute(single.select("doc_id", "text").collect(), 5, 80)
    assert apart.columns == cols and {r.doc_id for r in apart.collect()} == {i for i, (_, c) in want.items() if c == i}
    mixed = pipeline.mixed(spark, apart, "").cache()
    assert mixed.columns == cols and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    encode = plain("word_bpe_49k.json")
    # A copy that the mix takes in part is cut, so a document may have two texts; the rows hold the words that the mix takes.
    text, words = {}, Counter()
    for r in mixed.collect():
        text.setdefault(r.doc_id, set()).add(r.text)
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {r.doc_id: r.taken for r in take_mix(apart).collect() if r.taken}
    pieces = pipeline.packed(spark, mixed, "").collect()
    assert {p.doc_id for p in pieces} == set(text) and public_tokenizers
    for p in pieces:
        whole = [encode(t) + [1] for t in text[p.doc_id]]
        assert any(len(ids) == p.doc_tokens and p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for ids in whole)


def test_run_names_four_or_five_stages(spark):
    assert len(pipeline.STAGES) in (4, 5) and pipeline.ORACLE_SQL is None
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
