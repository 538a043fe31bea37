"""Diagnosis queries over the driver's tables: labels derived from ``events``.

model = 'm' + user_id mod 8; task = 'W' or 'b' + event_id mod 100; the code follows
from agreed ids; an error is a HIT, a purchase a PARTIAL, and the greatest score counts.
The dense form has fewer tasks, so that all models meet all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.taxonomy import CODES, dim_code, dim_code_sql
from tessera.operators import statistics as S
from tessera.registry import query, table

_PREFIX = "CASE WHEN event_id % 3 = 0 THEN 'W' ELSE 'b' END"
_SCORE = "CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END"


def labels(spark: SparkSession, sf_dir: str, dense: bool = False, where: str = "true") -> DataFrame:
    """model, task, code, score; one row each."""
    events = table(spark, sf_dir, "events").where(where)
    task, place = (f"concat({_PREFIX}, cast(event_id % 5 as string))", "(event_id div 5) % 45") if dense else (f"concat({_PREFIX}, cast(event_id % 100 as string))", "(event_id * 7 + user_id) % 45")
    rows = events.selectExpr("concat('m', cast(user_id % 8 as string)) as model", f"{task} as task", f"cast({place} as int) as ord", f"{_SCORE} as score")
    rows = rows.groupBy("model", "task", "ord").agg(F.max("score").alias("score"))
    return rows.join(F.broadcast(dim_code(spark).select("ord", "code")), "ord").drop("ord")


def records(label_rows: DataFrame) -> DataFrame:
    """One row per analysis (model, task), its source set and a severity that follows from its HITs."""
    found = label_rows.groupBy("model", "task").agg(S.hits().alias("h"))
    severity = F.expr("CASE WHEN h >= 3 THEN 'high' WHEN h = 2 THEN 'medium' WHEN h = 1 THEN 'low' WHEN task LIKE '%7' THEN NULL ELSE 'none' END")
    return found.select("model", "task", F.when(F.col("task").startswith("W"), "W").otherwise("b").alias("source_set"), severity.alias("severity"))


def _cte(dense: bool = False, where: str = "true", name: str = "labels") -> str:
    task, place = ("event_id % 5", "(event_id // 5) % 45") if dense else ("event_id % 100", "(event_id * 7 + user_id) % 45")
    return f"""{name} AS (SELECT e.model, e.task, d.code, e.score FROM (
      SELECT 'm' || (user_id % 8) AS model, {_PREFIX} || ({task}) AS task, {place} AS ord, max({_SCORE}) AS score
      FROM events WHERE {where} GROUP BY 1, 2, 3) e JOIN dim d ON d.ord = e.ord)"""


_RECORDS = """records AS (SELECT model, task, CASE WHEN task LIKE 'W%' THEN 'W' ELSE 'b' END AS source_set,
      CASE WHEN h >= 3 THEN 'high' WHEN h = 2 THEN 'medium' WHEN h = 1 THEN 'low' WHEN task LIKE '%7' THEN NULL ELSE 'none' END AS severity
      FROM (SELECT model, task, count(*) FILTER (score = 2) AS h FROM labels GROUP BY 1, 2))"""
_BASE = f"WITH {dim_code_sql()}, {_cte()}, {_RECORDS}"
_DENSE = f"WITH {dim_code_sql()}, {_cte(dense=True)}, {_RECORDS}"
_TOTALS = """SELECT d.ord, d.code, d.name, d.stage, d.pillar, count(*) FILTER (l.score = 2) AS hits, count(*) FILTER (l.score = 1) AS partials
    FROM dim d LEFT JOIN labels l ON l.code = d.code GROUP BY 1, 2, 3, 4, 5"""


def label_inputs(spark: SparkSession, sf_dir: str, dense: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = labels(spark, sf_dir, dense)
    return found, records(found), dim_code(spark)


@query("A1_code_totals", f"{_BASE} {_TOTALS}")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, dim = label_inputs(spark, sf_dir)
    return S.totals_by_code(found, dim)


@query("A2_model_totals", f"""{_BASE} SELECT m.model, m.analyses, d.code, count(*) FILTER (l.score = 2) AS hits, count(*) FILTER (l.score = 1) AS partials
    FROM (SELECT model, count(*) AS analyses FROM records GROUP BY 1) m CROSS JOIN dim d LEFT JOIN labels l ON l.model = m.model AND l.code = d.code GROUP BY 1, 2, 3""")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.totals_by_model(*label_inputs(spark, sf_dir))


@query("A3_J9_code_model_grid", f"""{_BASE} SELECT d.ord, d.code, m.model, count(l.score) AS n
    FROM (SELECT DISTINCT model FROM records) m CROSS JOIN dim d LEFT JOIN labels l ON l.model = m.model AND l.code = d.code AND l.score = 2 GROUP BY 1, 2, 3""")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recs, dim = label_inputs(spark, sf_dir)
    return S.grid(found, dim, "model", recs).select("ord", "code", "model", "n")


@query("A4_hit_rates", f"""{_BASE} SELECT t.*, n.analyses, 100.0::DOUBLE * t.hits / n.analyses AS hit_pct FROM ({_TOTALS}) t, (SELECT greatest(count(*), 1) AS analyses FROM records) n""")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hit_rates(*label_inputs(spark, sf_dir))


@query("W10_ranked_codes", f"{_BASE} SELECT *, row_number() OVER (ORDER BY hits DESC, code) AS rank FROM ({_TOTALS})", longs=("rank",))
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, dim = label_inputs(spark, sf_dir)
    return S.ranked(S.totals_by_code(found, dim))


@query("A5_model_load", f"""{_BASE}, per AS (SELECT model, task, count(*) FILTER (score = 2) AS hits, count(*) FILTER (score = 1) AS partials FROM labels GROUP BY 1, 2)
    SELECT r.model, count(*) AS analyses, sum(hits)::BIGINT AS hits, sum(partials)::BIGINT AS partials, sum(hits) / count(*)::DOUBLE AS mean_hits,
      count(*) FILTER (severity = 'high') AS severity_high, count(*) FILTER (severity = 'medium') AS severity_medium, count(*) FILTER (severity = 'low') AS severity_low,
      count(*) FILTER (severity = 'none') AS severity_none, count(*) FILTER (severity IS NULL) AS severity_unknown
    FROM records r JOIN per USING (model, task) GROUP BY 1""")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recs, _ = label_inputs(spark, sf_dir)
    return S.model_load(found, recs)


_CELLS = "coalesce(stage, 'all') AS stage, coalesce(pillar, 'all') AS pillar, count(*) AS hits FROM labels JOIN dim USING (code) WHERE score = 2"


@query("A6_root_cause_grid", f"{_BASE} SELECT {_CELLS} GROUP BY CUBE (stage, pillar)")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, dim = label_inputs(spark, sf_dir)
    return S.root_cause_grid(found, dim)


@query("A6_root_cause_by_model", f"{_BASE} SELECT model, {_CELLS} GROUP BY GROUPING SETS ((model, stage, pillar), (model, stage), (model, pillar), (model))")
def a6_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, dim = label_inputs(spark, sf_dir)
    return S.root_cause_grid(found, dim, ["model"])


@query("A7_slice_rates", f"""{_BASE}, n AS (SELECT greatest(count(*) FILTER (source_set = 'W'), 1) AS w, greatest(count(*) FILTER (source_set = 'b'), 1) AS b FROM records),
    h AS (SELECT d.code, count(*) FILTER (l.task LIKE 'W%') AS w, count(*) FILTER (l.task LIKE 'b%') AS b FROM dim d LEFT JOIN labels l ON l.code = d.code AND l.score = 2 GROUP BY 1)
    SELECT code, 100.0::DOUBLE * h.w / n.w AS rate_first, 100.0::DOUBLE * h.b / n.b AS rate_second, 100.0::DOUBLE * h.w / n.w - 100.0::DOUBLE * h.b / n.b AS delta_pp FROM h, n""")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recs, dim = label_inputs(spark, sf_dir)
    return S.slice_rates(found.withColumn("source_set", F.left("task", F.lit(1))), recs, dim, "source_set", "W", "b")


_PAIRS = """hit AS (SELECT model, task, code, ord FROM labels JOIN dim USING (code) WHERE score = 2),
    sup AS (SELECT code, count(*) AS s FROM hit GROUP BY 1),
    pair AS (SELECT x.code AS a, y.code AS b, count(*) AS n FROM hit x JOIN hit y ON x.model = y.model AND x.task = y.task AND x.ord < y.ord GROUP BY 1, 2),
    lifted AS (SELECT a, b, n, sa.s AS n_a, sb.s AS n_b, (n / t.total::DOUBLE) / ((sa.s / t.total::DOUBLE) * (sb.s / t.total::DOUBLE)) AS lift
      FROM pair JOIN sup sa ON sa.code = a JOIN sup sb ON sb.code = b, (SELECT count(*) AS total FROM records) t)"""


@query("J8_A8_A9_cooccurrence_lift", f"{_BASE}, {_PAIRS} SELECT * FROM lifted")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cooccurrence(*label_inputs(spark, sf_dir))


@query("O2_top_pairs", f"{_BASE}, {_PAIRS} SELECT * FROM lifted ORDER BY n DESC, a DESC, b DESC LIMIT 40")
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_pairs(S.cooccurrence(*label_inputs(spark, sf_dir)))


def _agreement_sql(base: str) -> str:
    return f"""{base}, m AS (SELECT task, count(DISTINCT model) AS models FROM records GROUP BY 1),
    c AS (SELECT task, code, count(DISTINCT model) AS n FROM labels WHERE score = 2 GROUP BY 1, 2),
    t AS (SELECT c.task, count(*) FILTER (n = models) AS universal, count(*) FILTER (n = 1) AS solo,
      array_to_string(list(code || ':' || n ORDER BY n DESC, code DESC)[1:4], ' ') AS shared FROM c JOIN m USING (task) GROUP BY 1)
    SELECT m.task, m.models, coalesce(universal, 0) AS universal, coalesce(solo, 0) AS solo, coalesce(shared, '') AS shared FROM m LEFT JOIN t USING (task)"""


@query("A10_O5_agreement_dense", _agreement_sql(_DENSE))
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recs, _ = label_inputs(spark, sf_dir, dense=True)
    return S.agreement(found, recs)


@query("A10_O5_agreement_sparse", _agreement_sql(_BASE))
def a10_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recs, _ = label_inputs(spark, sf_dir)
    return S.agreement(found, recs)


@query("O4_tasks_by_universal", f"SELECT task, universal, row_number() OVER (ORDER BY universal DESC, task) AS place FROM ({_agreement_sql(_DENSE)}) ORDER BY place LIMIT 20", longs=("place",))
def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = a10(spark, sf_dir).orderBy(F.desc("universal"), "task").limit(20)
    from pyspark.sql import Window

    return ordered.select("task", "universal", F.row_number().over(Window.orderBy(F.desc("universal"), "task")).alias("place"))


_PROPS = "CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INT)"


@query("A11_rule_frequencies", f"""SELECT rule, count(DISTINCT (model, task)) AS analyses, count(*) AS citations FROM (
    SELECT 'm' || (user_id % 8) AS model, {_PREFIX} || (event_id % 100) AS task,
      CASE WHEN event_type <> 'view' THEN CAST(nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '') AS INTEGER) % 12 END AS rule FROM events) WHERE rule IS NOT NULL GROUP BY 1""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')")
    rows = events.select(F.expr("concat('m', cast(user_id % 8 as string))").alias("model"), F.expr(f"concat({_PREFIX}, cast(event_id % 100 as string))").alias("task"), F.when(F.col("event_type") != "view", k % 12).alias("rule"))
    return S.rule_frequencies(rows)


_HALVES = f"WITH {dim_code_sql()}, {_cte(True, 'event_id % 2 = 0', 'first')}, {_cte(True, 'event_id % 2 = 1', 'second')}"


@query("A12_J6_U2_kappa_by_code", f"""{_HALVES}, keys AS (SELECT DISTINCT model, task FROM first INTERSECT SELECT DISTINCT model, task FROM second),
    x AS (SELECT DISTINCT model, task, code FROM first JOIN keys USING (model, task) WHERE score = 2), y AS (SELECT DISTINCT model, task, code FROM second JOIN keys USING (model, task) WHERE score = 2),
    c AS (SELECT code, count(*) FILTER (a AND b) AS agreed, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (
      SELECT coalesce(x.code, y.code) AS code, x.code IS NOT NULL AS a, y.code IS NOT NULL AS b FROM x FULL JOIN y ON x.model = y.model AND x.task = y.task AND x.code = y.code) GROUP BY 1),
    p AS (SELECT c.*, k.n, (k.n - only_a - only_b) / k.n::DOUBLE AS po, (agreed + only_a) / k.n::DOUBLE AS pa, (agreed + only_b) / k.n::DOUBLE AS pb FROM c, (SELECT count(*) AS n FROM keys) k)
    SELECT code, n, agreed, only_a, only_b, CASE WHEN pa * pb + (1 - pa) * (1 - pb) = 1 THEN CASE WHEN po = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      ELSE (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END AS kappa FROM p""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (labels(spark, sf_dir, True, f"event_id % 2 = {k}") for k in (0, 1))
    keys = first.select("model", "task").intersect(second.select("model", "task"))
    return S.kappa_by_code(first, second, keys, dim_code(spark))


@query("A12_kappa_two_raters", """SELECT n, agreed, only_a, only_b, CASE WHEN n = 0 THEN NULL WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (po - pe) / (1 - pe) END AS kappa FROM (
    SELECT *, (n - only_a - only_b) / n::DOUBLE AS po, ((agreed + only_a) / n::DOUBLE) * ((agreed + only_b) / n::DOUBLE) + (1 - (agreed + only_a) / n::DOUBLE) * (1 - (agreed + only_b) / n::DOUBLE) AS pe FROM (
      SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS agreed, count(*) FILTER (quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_b FROM labels))""")
def a12_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    counts = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("agreed"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    return counts.withColumn("kappa", S.kappa(*(F.col(c) for c in ("n", "agreed", "only_a", "only_b"))))


@query("A13_polarity", """SELECT lang, n, mention_pct, hit_pct, hit_pct > 0.6::DOUBLE * mention_pct AS bad FROM (
    SELECT lang, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (contains(lower(text), 'license')) / count(*) AS mention_pct, 100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*) AS hit_pct
    FROM documents JOIN labels USING (doc_id) GROUP BY 1)""")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in documents against their quality, by language."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return S.polarity(rows, "lang", F.contains(F.lower("text"), F.lit("license")), F.col("quality") == 1)


def _head_sql(name: str) -> str:
    return f"(SELECT d.code FROM dim d LEFT JOIN {name} l ON l.code = d.code GROUP BY d.code, d.ord ORDER BY count(*) FILTER (l.score = 2) DESC, d.ord LIMIT 10)"


@query("A14_J7_O3_head_overlap", f"{_HALVES} SELECT count(*) AS overlap, count(*) >= 4 AS ok FROM {_head_sql('first')} x JOIN {_head_sql('second')} y USING (code)")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = dim_code(spark)
    halves = (S.totals_by_code(labels(spark, sf_dir, True, f"event_id % 2 = {k}"), dim).withColumnRenamed("hits", "rate") for k in (0, 1))
    return S.head_overlap(*halves)


@query("A15_status", f"{_BASE} SELECT coalesce(model, 'TOTAL') AS model, count(*) FILTER (severity IS NOT NULL AND severity <> 'high') AS passing, count(*) AS total FROM records GROUP BY ROLLUP (model)")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, recs, _ = label_inputs(spark, sf_dir)
    return S.status(recs.select("model", F.coalesce(F.col("severity") != "high", F.lit(False)).alias("ok")))


@query("U6_J1_remaining", f"{_BASE} SELECT model, task FROM records r WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.model = r.model AND l.task = r.task AND l.score = 2)")
def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recs, _ = label_inputs(spark, sf_dir)
    return S.remaining(recs, found.where("score = 2"), ["model", "task"])


@query("J2_P9_labels_long", f"{_BASE} SELECT l.model, l.task, l.code, d.name, d.stage, d.pillar, l.score, CASE l.score WHEN 2 THEN 'HIT' ELSE 'PARTIAL' END AS verdict FROM labels l JOIN dim d USING (code) WHERE l.score > 0")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, dim = label_inputs(spark, sf_dir)
    return S.tidy_labels(found, dim)


@query("J3_source_set", f"""{_BASE} SELECT r.model, r.task, coalesce(s.source_set, 'unknown') AS source_set FROM records r
    LEFT JOIN (SELECT DISTINCT task, source_set FROM records WHERE task LIKE '%1%') s USING (task)""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, recs, _ = label_inputs(spark, sf_dir)
    side = recs.where(F.contains("task", F.lit("1"))).select("task", "source_set").distinct()
    return recs.select("model", "task").join(side, "task", "left").select("model", "task", F.coalesce("source_set", F.lit("unknown")).alias("source_set"))


@query("A27_taxonomy_check", f"""{_BASE}, u AS (SELECT *, code IN (SELECT code FROM labels WHERE score > 0) AS used FROM dim)
    SELECT 'stage' AS kind, stage AS key, count(*) AS n, count(*) FILTER (used) AS used, max(CAST(split_part(code, '.', 2) AS INTEGER)) = count(*) AS contiguous FROM u GROUP BY 1, 2
    UNION ALL SELECT 'pillar', pillar, count(*), count(*) FILTER (used), true FROM u GROUP BY 1, 2""")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy's numbers, and how many of its codes the labels use."""
    found, _, dim = label_inputs(spark, sf_dir)
    return S.taxonomy_counts(dim, found)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each failure pattern occurs by model: one row a code, one column a model."""
    found, recs, dim = label_inputs(spark, sf_dir)
    models = [f"m{k}" for k in range(8)]
    wide = found.where("score = 2").groupBy("code").pivot("model", models).count()
    totals = S.ranked(S.hit_rates(found, recs, dim))
    return totals.join(wide, "code", "left").fillna(0, models)


@query("flagship_pattern_matrix", f"""{_BASE}, t AS (SELECT *, row_number() OVER (ORDER BY hits DESC, code) AS rank FROM ({_TOTALS})), n AS (SELECT greatest(count(*), 1) AS analyses FROM records)
    SELECT t.*, n.analyses, 100.0::DOUBLE * t.hits / n.analyses AS hit_pct, {", ".join(f"(SELECT count(*) FROM labels l WHERE l.code = t.code AND l.score = 2 AND l.model = 'm{k}') AS m{k}" for k in range(8))} FROM t, n""", longs=("rank",))
def flagship_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


assert len(CODES) == 45
