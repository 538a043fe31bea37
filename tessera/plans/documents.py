"""Document queries over ``documents``, ``benchmark`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as C
from tessera.operators import corpus as K
from tessera.operators import documents as D
from tessera.operators import spans as N
from tessera.registry import query, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_LINES = "lines AS (SELECT doc_id, u.pos - 1 AS pos, u.line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, unnest(l) WITH ORDINALITY AS u(line, pos))"

#: Lines without the white space that Python's strip takes off.
_STRIPPED = r"regexp_replace(line, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line: the driver's documents have lines where analyses have issues."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_MARKED = "(pos + 1)::VARCHAR || '. ' || line || CASE WHEN pos % 2 = 0 THEN ' [stage: A | root cause: depth]' ELSE ' ' END"
_SEGMENT = rf"regexp_replace({_MARKED}, '^\s+|\s+$', '', 'g')"


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as analyses: under one stage's heading each line is an issue, each second one with a trailer."""
    mark = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.when(i % 2 == 0, " [stage: A | root cause: depth]").otherwise(" "))
    body = F.concat(F.lit("## A. Ideation & Planning\n"), F.array_join(F.transform(F.split("text", "\n"), mark), "\n"))
    kinds = {"reason": "string", "quotable": "string", "artifact": "string"}
    return docs(spark, sf_dir).where("text is not null").select(F.col("doc_id").cast("string").alias("path"), body.alias("body"), *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


@query("T1_1_T1_5_T1_9_W2_document_gate", f"""WITH {_LINES}, s AS (SELECT doc_id, {_MARKED} AS raw, {_SEGMENT} AS seg, pos % 2 = 0 AS marked FROM lines)
    SELECT doc_id::VARCHAR AS path, sum(length(raw) + 1) + 25 AS chars, count(*) AS issues, (sum(length(raw) + 1) + 25) / count(*)::DOUBLE AS ratio, count(*) AS n_segs, count(*) FILTER (length(seg) < 100) AS tiny, count(*) FILTER (length(seg) < 200) AS short, count(*) FILTER (marked) AS labelled FROM s GROUP BY 1""", longs=("chars", "issues", "n_segs", "tiny", "short", "labelled"))
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_gate(_analyses(spark, sf_dir)).select("path", "chars", "issues", "ratio", "n_segs", "tiny", "short", "labelled")


@query("T1_2_T1_3_section_floors", f"""WITH {_LINES}, s AS (SELECT doc_id, sum(length({_MARKED}) + 1) AS n, count(*) AS issues FROM lines GROUP BY 1)
    SELECT doc_id::VARCHAR AS path, n < 760 AS too_short, issues < 3 AS too_few, 14 AS missing FROM s""", longs=("missing",))
def t1_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section stands; its floors hold or not, and all others are missing."""
    begins = lambda p: F.size(F.filter("problems", lambda x: F.startswith(x, F.lit(p))))
    gate = D.document_gate(_analyses(spark, sf_dir))
    return gate.select("path", (begins("section too short:A. Ideation") > 0).alias("too_short"), (begins("section too few issues:A. Ideation") > 0).alias("too_few"), begins("missing section:").alias("missing"))


@query("T1_6_anchors", r"""SELECT doc_id, len(regexp_extract_all(text, '`[^`\n]{2,}`')) + len(regexp_extract_all(text, '\b\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\b'))
    + len(regexp_extract_all(text, '\b[\w./-]+\.(?:py|json|jsonl|md|txt|csv|npy|npz|log|sh|ya?ml)\b')) + len(regexp_extract_all(text, '\b[Ll](?:ine)?\s?\d+\b|:\d+\b'))
    + len(regexp_extract_all(text, '10\.\d{4,}/\S+|arXiv:\d{4}\.\d{4,}')) AS anchors FROM (SELECT doc_id, regexp_replace(text, '[^ -~\n]', 'e', 'g') AS text FROM documents)""", longs=("anchors",))
def t1_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over texts with non-ASCII letters replaced, where both engines' word classes agree."""
    return docs(spark, sf_dir).select("doc_id", D.anchor_count(F.regexp_replace("text", r"[^ -~\n]", "e")).alias("anchors"))


@query("W14_T1_7_duplicate_share", r"""SELECT doc_id, share, share > 0.08::DOUBLE AS padded FROM (SELECT doc_id, CASE WHEN length(flat) < 600 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct(w)) / len(w)::DOUBLE END AS share FROM (
    SELECT doc_id, flat, list_transform(range(1, greatest(length(flat) - 59, 1)::BIGINT, 30), lambda i: substr(flat, i, 60)) AS w FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM documents)))""")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.duplicate_share(F.col("text")).alias("share")).withColumn("padded", F.col("share") > D.MAX_DUPLICATE)


@query("T1_9_trailers", f"WITH {_LINES} SELECT doc_id, count(*) FILTER (regexp_matches(line, '[a-z]\\.$')) AS labelled, count(*) AS n, count(*) FILTER (regexp_matches(line, '[a-z]\\.$')) / count(*)::DOUBLE >= 0.85::DOUBLE AS ok FROM lines GROUP BY 1")
def t1_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end a sentence stand for issues with a well-formed trailer."""
    rows = lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("line").rlike(r"[a-z]\.$")).alias("labelled"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("ok", D.share(F.col("labelled"), F.col("n")) >= D.MIN_LABELLED)


@query("J10_contained_passages", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE trim(b.text) <> ''")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.contained(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("J10_T1_8_verbatim", f"""WITH {_LINES}, long AS (SELECT doc_id, {_STRIPPED} AS line FROM lines WHERE length({_STRIPPED}) >= 120),
    copied AS (SELECT doc_id, sum(length(line)) AS n FROM long WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(b.text, line)) GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) / greatest(coalesce(length(text), 0), 1)::DOUBLE AS copied FROM documents LEFT JOIN copied USING (doc_id)""")
def t1_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents against all texts of the benchmark."""
    return N.copied_share(docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("T1_8_copied_from_others", f"""WITH {_LINES}, long AS (SELECT doc_id, {_STRIPPED} AS line FROM lines WHERE length({_STRIPPED}) >= 120),
    copied AS (SELECT doc_id, sum(length(line)) AS n FROM long l WHERE EXISTS (SELECT 1 FROM documents o WHERE o.doc_id <> l.doc_id AND contains(o.text, l.line)) GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) / greatest(coalesce(length(text), 0), 1)::DOUBLE AS copied FROM documents LEFT JOIN copied USING (doc_id)""")
def t1_8_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents against all other documents."""
    rows = docs(spark, sf_dir)
    return N.copied_share(rows, rows.select(F.col("doc_id").alias("id"), "text"), others=True)


@query("J10_traceable_quotes", """WITH q AS (SELECT doc_id, text, substr(text, 30 + doc_id % 50, 20 + doc_id % 60) AS own FROM documents)
    SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE 1 + fits END::BIGINT AS quotes, coalesce(fits, 0)::BIGINT AS traceable FROM (SELECT doc_id, text, CASE WHEN length(own) >= 20 AND NOT contains(own, chr(10)) AND NOT contains(own, '`') THEN 1 ELSE 0 END AS fits FROM q)""")
def j10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critiques that quote a passage of each document, and one that no document has, against all documents."""
    rows, key = docs(spark, sf_dir), F.col("doc_id")
    own = F.substr("text", (30 + key % 50).cast("int"), (20 + key % 60).cast("int"))
    said = F.concat(F.lit("It says `"), own, F.lit("` and\n`nowhere said in number "), key.cast("string"), F.lit("`."))
    return N.traceable_quotes(rows.select("doc_id", said.alias("text")), rows.select(F.col("doc_id").alias("id"), "text"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: a line is a block, a short one (below 120 characters) a heading."""
    rows = lines(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("paper_id"), "pos", F.lit("text").alias("type"), F.col("line").alias("text"), F.when(F.length("line") < 120, 1).alias("text_level"))


_TRIMMED = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_BUCKET = "CASE " + " ".join(f"WHEN regexp_matches({_TRIMMED}, '{p}') THEN '{b}'" for b, p in K.BUCKETS) + f" ELSE left({_TRIMMED}, 40) END"


@query("W5_F14_paper_sections", f"""WITH {_LINES}, h AS (SELECT doc_id, pos, {_TRIMMED} AS t, length(line) < 120 AS head, CASE WHEN length(line) < 120 THEN {_BUCKET} END AS b FROM lines),
    f AS (SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '_pre') AS section FROM h)
    SELECT doc_id AS paper_id, section, min(pos) AS first, string_agg(t, ' ' ORDER BY pos) AS text FROM f WHERE NOT head AND t <> '' GROUP BY 1, 2""", longs=("first",))
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.paper_sections(_blocks(spark, sf_dir))


@query("W11_first_section", f"WITH {_LINES} SELECT doc_id, key, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS r FROM (SELECT doc_id, lower(left(line, 1)) AS key, pos, line FROM lines WHERE line <> '')) WHERE r = 1")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).where("line != ''").withColumn("key", F.lower(F.left("line", F.lit(1))))
    return D.first_by_key(rows, ["doc_id", "key"], ["pos"]).select("doc_id", "key", F.col("pos").cast("bigint").alias("pos"), "line")


@query("W12_first_title", f"""WITH {_LINES} SELECT doc_id AS paper_id, coalesce(arg_min({_TRIMMED}, pos) FILTER (length(line) < 120 AND length({_TRIMMED}) > 12 AND NOT contains(lower({_TRIMMED}), 'cite')), '(untitled)') AS title FROM lines GROUP BY 1""")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.paper_titles(_blocks(spark, sf_dir))


@query("O8_F32_one_line", "SELECT doc_id, replace(left(coalesce(text, ''), 160), chr(10), ' ') AS short FROM documents")
def o8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.one_line(F.col("text")).alias("short"))


@query("F16_slugs", r"SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48) AS slug, left(regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g'), 120) AS file FROM pages")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.slug(F.col("url")).alias("slug"), C.file_slug(F.col("url")).alias("file"))


@query("F28_P13_first_url", r"""SELECT page_id, CASE WHEN regexp_matches(html, 'https?://[^\s"''\\)>]+') THEN regexp_extract(html, '(https?://[^\s"''\\)>]+)', 1) END AS first_url,
    regexp_matches(lower(split_part(url, '?', 1)), '\.(jpe?g|png|gif|tiff?|svg|bmp)$') AS image FROM pages""")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.first_url(F.col("html")).alias("first_url"), C.looks_like_image(F.col("url")).alias("image"))


@query("F14_section_bucket", f"WITH {_LINES} SELECT doc_id, pos, {_BUCKET.replace(_TRIMMED, 'line')} AS bucket FROM lines", longs=("pos",))
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a header."""
    return lines(spark, sf_dir).select("doc_id", "pos", K.bucket(F.col("line")).alias("bucket"))


@query("A28_O1_document_profile", f"""WITH {_LINES} SELECT source, count(DISTINCT doc_id) AS docs, count(line) AS lines, count(*) FILTER (length(line) < 100) / greatest(count(line), 1)::DOUBLE AS tiny_frac FROM documents LEFT JOIN lines USING (doc_id) GROUP BY 1""")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.profile(docs(spark, sf_dir), "source")
