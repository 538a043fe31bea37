"""Document operators: markers, sections, segments, anchors, containment and the two gates.

A document is one row; sections and segments are exploded from it.  Patterns run in
Java with line feeds as the only line ends where lines matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import LINE_BREAK, duplicate_share, non_null, strip, thin_scale
from tessera.functions.taxonomy import CODES, SEVERITIES

# The grammar of issue markers, headings, checklist rows, trailers and anchors.
CIRCLED = "[①-⒛⓪-⓿❶-➓㉑-㉟㊱-㊿]"
ISSUE = r"(?md)^\s*(?:[-*+]\s+)?\*{0,2}(?:[\[({][^\d\n]{0,10}\d+[\])}]|(?:(?:[Ii]ssue|[Ff]inding|[Pp]roblem)\s+)\d+[.)\]:—(|\s\*]|(?:[A-Za-z#])?[-–—]?\d+[.)\]—(|\s\*]|" + CIRCLED + r"\s)"
HEADING = r"(?md)^##+\s+(.*)$"
CHECKLIST_ROW = r"(?md)^\s*\|"
TRAILER = r"(?i)\[\s*stage\s*:\s*([A-FX])\s*\|\s*root\s*cause\s*:\s*(grounding|depth|integrity|robustness)\s*\]"
ANCHORS = [
    r"`[^`\n]{2,}`",
    r"\b\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\b",
    r"\b[\w./-]+\.(?:py|json|jsonl|md|txt|csv|npy|npz|log|sh|ya?ml)\b",
    r"\b[Ll](?:ine)?\s?\d+\b|:\d+\b",
    r"10\.\d{4,}/\S+|arXiv:\d{4}\.\d{4,}",
]
# Section key, label, heading pattern, least characters, least issues.
SECTIONS = [
    ("core", "Core Verdict", r"Core Verdict", 850, None),
    ("meta", "Metadata", r"Metadata", 720, None),
    ("arc", "Trajectory Arc", r"Trajectory Arc", 380, None),
    ("fair", "Credit Due", r"Credit Due", 760, None),
    ("s1", "A. Ideation & Planning", r"A\.\s*Ideation|\bIdeation\b", 760, 3),
    ("s2", "B. Retrieval & Synthesis", r"B\.\s*Retrieval|\bRetrieval\b", 1020, 4),
    ("s3", "C. Execution & Implementation", r"C\.\s*Execution|\bExecution\b", 2550, 10),
    ("s4", "D. Analysis & Interpretation", r"D\.\s*Analysis|\bAnalysis\b", 600, 3),
    ("s5", "E. Writing & Documentation", r"E\.\s*Writing|\bWriting\b", 640, 3),
    ("s6", "F. Self-Verification & Review", r"F\.\s*Self-Verification|Self-Verification|\bReview\b", 640, 3),
    ("sx", "X. Cross-Stage Dynamics", r"X\.\s*Cross-Stage|Cross-Stage", 520, 2),
    ("checklist", "Sentence-by-Sentence Checklist", r"Sentence-by-Sentence Checklist|\bChecklist\b", 1100, None),
    ("grounding", "Numerical Grounding Notes", r"Numerical Grounding|\bGrounding\b", 600, None),
    ("retract", "Retraction / Correction Log", r"Retraction|Correction Log", 340, None),
    ("verdict", "One-Line Verdict", r"One-Line Verdict", 210, None),
]
STAGE_KEYS = [k for k, *_, need in SECTIONS if need]
MIN_CHARS, MIN_ISSUES, MIN_RATIO, MIN_ROWS, MIN_ANCHORS, MIN_QUOTES = 16000, 28, 300, 12, 300, 8
MAX_TINY, MAX_THIN, MIN_ANCHORED, MIN_LABELLED, MAX_DUPLICATE, MAX_COPIED = 0.05, 0.28, 0.85, 0.85, 0.08, 0.20
THIN_REASONS = ("no_decision", "no_computation", "timeout")


def issue_count(text: Column) -> Column:
    """T1.10: issue markers."""
    return F.regexp_count(text, F.lit(ISSUE))


def anchor_count(text: Column) -> Column:
    """T1.6: matches of five families, an overlap counted in each."""
    counts = [F.regexp_count(text, F.lit(p)) for p in ANCHORS]
    return sum(counts[1:], counts[0])


def segments(text: Column) -> Column:
    """Trimmed text from each marker to the next; what stands before the first goes."""
    return F.transform(F.filter(F.split(text, f"(?={ISSUE})"), lambda s: s.rlike("^(?:" + ISSUE + ")")), strip)


def sections(docs: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``sections``, a map from key to text.

    Headings are taken in order; each claims the first key that matches it and that
    no earlier heading has claimed.
    """
    parts = F.filter(F.split(F.col(body), r"(?md)(?=^##+\s)"), lambda p: p.rlike(r"^##+\s"))
    heads = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(?d)^##+\s+(.*)", 1).alias("title"), F.regexp_replace(p, r"(?d)^##+\s+.*", "").alias("text")))
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(f"(?i){p}").alias("pattern")) for k, _, p, _, _ in SECTIONS])
    empty = F.from_json(F.lit("[]"), "array<struct<key string, text string>>")

    def claim(found: Column, head: Column) -> Column:
        free = F.filter(keys, lambda k: ~F.exists(found, lambda f: f["key"] == k["key"]) & F.rlike(head["title"], k["pattern"]))
        return F.when(F.size(free) > 0, F.concat(found, F.array(F.struct(F.try_element_at(free, F.lit(1))["key"].alias("key"), head["text"].alias("text"))))).otherwise(found)

    return docs.withColumn("_found", F.aggregate(heads, empty, claim)).withColumn("sections", F.map_from_entries("_found")).drop("_found")


def share(part: Column, whole: Column) -> Column:
    """A ratio with a denominator of one at least."""
    return part / F.greatest(whole, F.lit(1))


def verbatim(text: Column, quotable: Column, artifact: Column) -> tuple[Column, Column]:
    """J10, T1.8: quoted spans of 20 characters found in the sources; share of text in long lines found in the artifact."""
    quotes = F.regexp_extract_all(text, F.lit(r"`([^`\n]{20,})`"), 1)
    lines = F.transform(F.split(text, LINE_BREAK), strip)
    copied = F.aggregate(F.filter(lines, lambda x: (F.length(x) >= 120) & F.contains(artifact, x)), F.lit(0), lambda n, x: n + F.length(x))
    return F.size(F.filter(quotes, lambda q: F.contains(quotable, q))), share(copied, F.length(text))


def document_gate(docs: DataFrame) -> DataFrame:
    """Rows (path, body, reason, quotable, artifact) to measures, ordered problems and ok.

    Without sources the quote and copy rules are skipped.  The thin profile scales floors.
    """
    d = sections(docs).withColumn("thin", F.coalesce(F.col("reason").rlike("^(" + "|".join(THIN_REASONS) + ")"), F.lit(False)))
    d = d.withColumns({"chars": F.length("body"), "issues": issue_count(F.col("body")), "stars": F.regexp_count("body", F.lit("★"))})
    d = d.withColumn("ratio", F.col("chars") / F.greatest("issues", F.lit(1)))
    by_stage = F.flatten(F.array(*[F.coalesce(segments(F.try_element_at("sections", F.lit(k))), F.array().cast("array<string>")) for k in STAGE_KEYS]))
    d = d.withColumn("_staged", by_stage).withColumn("segs", F.when(F.size("_staged") > 0, F.col("_staged")).otherwise(segments(F.col("body"))))
    n = F.size("segs")
    count = lambda f: F.size(F.filter("segs", f))
    d = d.withColumns({"n_segs": n, "tiny": count(lambda s: F.length(s) < 100), "short": count(lambda s: F.length(s) < 200), "anchored": count(lambda s: anchor_count(s) >= 1), "labelled": count(lambda s: s.rlike(TRAILER)), "anchors": anchor_count(F.col("body")), "duplicate": duplicate_share(F.col("body"))})
    quotes, copied = verbatim(F.col("body"), F.col("quotable"), F.coalesce("artifact", F.lit("")))
    d = d.withColumns({"quotes": F.when(F.col("quotable").isNotNull(), quotes), "copied": F.when(F.col("quotable").isNotNull(), copied)})
    thin, pct = F.col("thin"), lambda c: F.concat(F.format_string("%.0f", F.bround(c * 100, 0)), F.lit("%"))

    def low(value: Column, floor: Column, text: str) -> Column:
        return F.when(value < floor, F.concat(F.lit(text), value.cast("string"), F.lit(" < "), floor.cast("string")))

    problems = [
        low(F.col("chars"), thin_scale(F.lit(MIN_CHARS), thin), "too short: "),
        low(F.col("issues"), thin_scale(F.lit(MIN_ISSUES), thin), "too few issues: "),
        F.when(F.col("ratio") < MIN_RATIO, F.concat(F.lit("chars/issue "), F.format_string("%.0f", F.bround("ratio", 0)), F.lit(" < 300"))),
    ]
    for key, label, _, floor, need in SECTIONS:
        text = F.try_element_at("sections", F.lit(key))
        problems += [F.when(text.isNull(), f"missing section:{label}"), low(F.length(text), thin_scale(F.lit(floor), thin), f"section too short:{label} ")]
        if need:
            problems.append(low(F.size(segments(text)), F.greatest(thin_scale(F.lit(need), thin), F.lit(2)), f"section too few issues:{label} "))
    rows = F.regexp_count(F.try_element_at("sections", F.lit("checklist")), F.lit(CHECKLIST_ROW))
    problems += [
        low(rows, thin_scale(F.lit(MIN_ROWS), thin), "checklist too few rows: "),
        F.when(share(F.col("tiny"), n) > MAX_TINY, F.concat(F.col("tiny").cast("string"), F.lit("/"), n.cast("string"), F.lit(" issues under 100 chars ("), pct(share(F.col("tiny"), n)), F.lit(" > 5%)"))),
        F.when(share(F.col("short"), n) > MAX_THIN, F.concat(F.lit("thin-issue share "), pct(share(F.col("short"), n)), F.lit(" > 28%"))),
        low(F.col("anchors"), thin_scale(F.lit(MIN_ANCHORS), thin), "too few verifiable anchors: "),
        F.when(share(F.col("anchored"), n) < MIN_ANCHORED, F.concat(F.lit("only "), pct(share(F.col("anchored"), n)), F.lit(" of issues carry a verifiable anchor (<85%)"))),
        F.when(F.col("duplicate") > MAX_DUPLICATE, F.concat(F.lit("near-duplicate share "), pct(F.col("duplicate")), F.lit(" > 8% (template padding)"))),
        F.when(F.col("quotes") < thin_scale(F.lit(MIN_QUOTES), thin), F.concat(F.lit("only "), F.col("quotes").cast("string"), F.lit(" verbatim-traceable quotes < "), thin_scale(F.lit(MIN_QUOTES), thin).cast("string"))),
        F.when(F.col("copied") > MAX_COPIED, F.concat(F.lit("verbatim-copied share "), pct(F.col("copied")), F.lit(" > 20%"))),
        F.when(share(F.col("labelled"), n) < MIN_LABELLED, F.concat(F.lit("only "), pct(share(F.col("labelled"), n)), F.lit(" of issues carry a well-formed [stage | root cause] trailer (<85%)"))),
    ]
    out = d.withColumn("problems", non_null(*problems)).withColumn("ok", F.size("problems") == 0)
    return out.select("path", "thin", "chars", "issues", "stars", "ratio", "n_segs", "tiny", "short", "anchors", "anchored", "labelled", "duplicate", "quotes", "copied", "problems", "ok")


# -- the classification gate -------------------------------------------------

# Named sections, what locates evidence, and the fair-credit section's names.
NAMED = r"Core Verdict|Metadata|Trajectory Arc|Credit Due|Ideation\s*&\s*Planning|Retrieval\s*&\s*Synthesis|Execution\s*&\s*Implementation|Analysis\s*&\s*Interpretation|Writing\s*&\s*Documentation|Self-Verification\s*&\s*Review|Cross-Stage\s*Dynamics|Sentence-by-Sentence Checklist|Numerical Grounding\s*Notes|Retraction\s*/\s*Correction Log|One-Line Verdict"
LOCATOR = (
    r"(?imdu)\bSection\s+[A-FX]\b|\bstage[: ]\s*[A-FX]\b|\b(?:" + NAMED + r")\b|\b(?:[Ii]ssue|[Ff]inding|[Pp]roblem)\s*#?\s*\d+\b|\brow\s*\d+\b"
    r"|§\s*[A-FX]?[-.]?\s*\d*|#\d+|\b[A-FX]\.\d+\b|\b[A-FX]\d{1,3}\b"
    r"|\"[^\"\n]{4,}\"|“[^”\n]{4,}”|'[^'\n]{4,}'|^.{0,30}:"
)
CREDIT = r"credit due|credit is due|give credit|fair credit"
CREDIT_REFERENCE = r"(?iu)[#§\"'“”‘’]{0,3}\s*(?:" + CREDIT + r")(?:\s*\([^)]*\))?\s*[\"'“”‘’]{0,2}"


def locatable(evidence: Column) -> Column:
    """T2.3: whether evidence points at a place."""
    return evidence.rlike(LOCATOR)


def only_credit(evidence: Column) -> Column:
    """T2.3: evidence that cites the fair-credit section and no other place."""
    return F.lower(evidence).rlike(CREDIT) & ~locatable(F.regexp_replace(evidence, CREDIT_REFERENCE, " "))


def classification_gate(docs: DataFrame) -> DataFrame:
    """Rows (path, body) with a classification in JSON, to ordered problems and ok.

    Works on the text as VARIANT, so wrong types are findings and not errors.
    """
    v = lambda p, t="string": F.expr(f"try_variant_get(v, '{p}', '{t}')")
    kind = lambda p: F.expr(f"schema_of_variant(variant_get(v, '{p}', 'variant'))")
    d = docs.withColumn("v", F.expr("try_parse_json(body)"))
    has = lambda k: F.expr(f"variant_get(v, '$.{k}', 'variant') is not null")
    labelled = lambda b: lambda x, i: F.struct(F.lit(b).alias("bucket"), i.alias("i"), x.alias("item"))
    items = F.concat(*[F.transform(F.coalesce(v(f"$.{b}", "array<variant>"), F.array().cast("array<variant>")), labelled(b)) for b in ("hits", "partials")])
    d = d.withColumn("items", items)
    valid = F.array(*[F.lit(c) for c, *_ in CODES])
    get = lambda x, p, t="string": F.call_function("try_variant_get", x["item"], F.lit(f"$.{p}"), F.lit(t))
    coded = F.transform("items", lambda x: F.struct(x["bucket"].alias("bucket"), x["i"].alias("i"), get(x, "code").alias("code"), get(x, "evidence").alias("evidence"), F.call_function("schema_of_variant", F.call_function("variant_get", x["item"], F.lit("$.confidence"), F.lit("variant"))).alias("kind"), get(x, "confidence", "double").alias("confidence")))
    d = d.withColumn("coded", coded)
    ok_codes = F.filter("coded", lambda x: F.array_contains(valid, x["code"]))
    d = d.withColumn("good", ok_codes)

    def judge(x: Column) -> Column:
        tag = F.concat(x["bucket"], F.lit("["), x["i"].cast("string"), F.lit("]"))
        named = F.concat(tag, F.lit(" "), x["code"], F.lit(": "))
        ev = x["evidence"]
        evidence = F.when(ev.isNull() | (F.length(strip(ev)) < 10), F.concat(named, F.lit("missing/short evidence"))).when(~locatable(ev), F.concat(named, F.lit("evidence not locatable (no section/issue ref)"))).when(only_credit(ev), F.concat(named, F.lit("evidence sourced ONLY from the Credit Due section")))
        numeric = x["kind"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
        confidence = F.when(x["kind"].isNotNull() & (x["kind"] != "VOID") & ~F.coalesce(numeric & x["confidence"].between(0, 1), F.lit(False)), F.concat(named, F.lit("confidence out of [0,1]")))
        bad = F.when(~F.coalesce(F.array_contains(valid, x["code"]), F.lit(False)), F.concat(tag, F.lit(" invalid code "), F.coalesce(x["code"], F.lit("None"))))
        return F.when(bad.isNotNull(), F.array(bad)).otherwise(non_null(evidence, confidence))

    repeated = F.transform(F.filter(F.array_distinct(F.transform("good", lambda x: x["code"])), lambda c: F.size(F.filter("good", lambda x: x["code"] == c)) > 1), lambda c: F.concat(c, F.lit(" appears more than once")))
    severity = v("$.overall_severity")
    hits = F.size(F.array_distinct(F.transform(F.filter("good", lambda x: x["bucket"] == "hits"), lambda x: x["code"])))
    rules = kind("$.iron_rules_cited")
    fixed = [F.when(F.col("v").isNull(), "invalid JSON")] + [F.when(F.col("v").isNotNull() & ~has(k), f"missing key: {k}") for k in ("task_id", "overall_severity", "summary", "hits", "partials")]
    fixed += [F.when(F.col("v").isNotNull() & ~F.coalesce(severity.isin(*SEVERITIES), F.lit(False)), "overall_severity not in the domain"), F.when(F.col("v").isNotNull() & (F.trim(F.coalesce(v("$.summary"), F.lit(""))) == ""), "empty summary")]
    fixed += [F.when(has(b) & ~F.startswith(kind(f"$.{b}"), F.lit("ARRAY")), f"{b} is not a list") for b in ("hits", "partials")]
    late = [
        F.when(rules.isNotNull() & (rules != "VOID") & ~rules.rlike("^ARRAY<(BIGINT|VOID)>$"), "iron_rules_cited must be a list of ints"),
        F.when((F.size("good") == 0) & (severity != "none"), "no hits/partials but a severity is given (expected 'none')"),
        F.when((hits > 0) & (severity == "none"), "HIT codes asserted but overall_severity='none'"),
    ]
    uncovered = F.flatten(F.transform(F.coalesce(v("$.uncovered", "array<variant>"), F.array().cast("array<variant>")), lambda u, i: non_null(*[F.when(F.coalesce(F.call_function("to_json", F.call_function("try_variant_get", u, F.lit(f"$.{k}"), F.lit("variant"))), F.lit("null")).isin("null", '""', "[]", "false", "0"), F.concat(F.lit("uncovered["), i.cast("string"), F.lit(f"] missing {k}"))) for k in ("mechanism", "why_each_fails", "nearest")], F.when(F.size(F.array_except(F.coalesce(F.call_function("try_variant_get", u, F.lit("$.nearest"), F.lit("array<string>")), F.array().cast("array<string>")), valid)) > 0, F.concat(F.lit("uncovered["), i.cast("string"), F.lit("] nearest has invalid codes"))))))
    problems = F.concat(non_null(*fixed), F.flatten(F.transform("coded", judge)), repeated, uncovered, non_null(*late))
    return d.withColumn("problems", problems).select("path", F.size("coded").alias("n_labels"), F.array_sort(F.array_distinct(F.transform("good", lambda x: x["code"]))).alias("codes"), "problems", (F.size("problems") == 0).alias("ok"))


def first_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order, null first; found with partial aggregation, so a frequent key costs a row a task."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def profile(docs: DataFrame, by: str, tiny: int = 100) -> DataFrame:
    """Documents, lines and the share of lines below ``tiny`` characters, by a column; null text has no lines."""
    parts = F.split(F.col("text"), "\n")
    rows = docs.select(by, F.coalesce(F.size(parts), F.lit(0)).alias("n"), F.coalesce(F.size(F.filter(parts, lambda s: F.length(s) < tiny)), F.lit(0)).alias("tiny"))
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.greatest("n", F.lit(0))).alias("lines"), F.sum(F.greatest("tiny", F.lit(0))).alias("tiny"))
    return counted.select(by, "docs", "lines", (F.col("tiny") / F.greatest("lines", F.lit(1))).alias("tiny_frac"))
