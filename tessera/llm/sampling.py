"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a sample over all labels; many labels share them alike, so each is learned.
MOST_ROWS = 100_000


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents that is never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def sample_by_label(labelled: DataFrame, per_label: int) -> DataFrame:
    """About ``per_label`` documents of each label (of MOST_ROWS in all, if labels are many), chosen by a hash of doc_id.

    ``labelled`` has doc_id and label, one row a document; the result doc_id, label and its ``place`` in the label's order.
    """
    learn = labelled.where(~held_out()).where("label is not null and doc_id is not null")
    counts = learn.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(float(min(per_label, MOST_ROWS / max(1, counts.count())))) / F.col("n")
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # One narrow row a label; where those are few, as they mostly are, Spark broadcasts them by their measured size.
    return learn.withColumn("place", place).join(counts, "label").where(F.col("place") < share).select("doc_id", "label", "place")


def sample_texts(docs: DataFrame, labelled: DataFrame, per_label: int, most_bytes: int) -> tuple[list[str], list]:
    """Whole texts and their labels: about ``per_label`` documents and at most ``most_bytes`` of text of each label.

    Documents are taken in the order of the sample's hash; one that would pass the bound is
    passed over.  What comes to the driver is bounded in rows first (each text of a document
    once, 4 * MOST_ROWS of them at most), then in bytes.
    """
    chosen = sample_by_label(labelled, per_label)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sized = rows.select("doc_id", "label", "place", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))
    held: dict = {}
    wanted = set()
    # A document that stands on very many rows comes once, and one with very many texts can't fill the driver either.
    for r in sized.dropDuplicates(["doc_id", "hash"]).orderBy("place", "doc_id", "hash").limit(4 * MOST_ROWS).collect():
        if held.get(r.label, 0) + r.size <= most_bytes and (r.doc_id, r.hash) not in wanted:
            held[r.label] = held.get(r.label, 0) + r.size
            wanted.add((r.doc_id, r.hash))
    if not wanted:
        return [], []
    kept = docs.sparkSession.createDataFrame(sorted(wanted), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash bigint")
    found = rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(kept), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("doc_id", "hash", "label", "text").orderBy("doc_id", "hash").toArrow()
    return found["text"].to_pylist(), found["label"].to_pylist()
