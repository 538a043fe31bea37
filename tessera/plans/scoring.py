"""Scoring queries: grammars over texts made from each row of the driver's tables, arithmetic over their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import methods as M
from tessera.functions import scalars as C
from tessera.operators import documents as D
from tessera.operators import predicates as P
from tessera.operators import scoring as R
from tessera.registry import query, table

_NUM = r"-?\d+\.?\d*"
_QTY = r"(?i)(-?\d+\.?\d*)\s*(?:\(\d+\))?\s*(eV|meV|kJ\s*/?\s*mol|kcal\s*/?\s*mol|Ha|Ry|Å|cm-?1|K)(?:$|[^a-zA-Z0-9])"


def _one_of(choices: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (at + 1).cast("int"))


def _sql_list(choices: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in choices) + "]"


# Texts with a number of the line item between two parts: units, spellings, and none.
_HEADS = ("-", "", "≥", "S = ", "−", "about ", "", "", "", "", "none", "ratio 1/")
_TAILS = ("(1) eV", " kJ/mol", "-fold sites", "/2", " eV", " meV", " Ry", " Ha", " cm⁻¹", " kcal mol", "", " Å")
_VALUES = f"v AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, {_sql_list(_HEADS)}[l_partkey % 12 + 1] || CASE WHEN l_partkey % 12 = 10 THEN '' ELSE (CASE WHEN l_suppkey % 2 = 0 THEN l_quantity::INT::VARCHAR ELSE l_quantity::INT || '.' || l_linenumber END) END || {_sql_list(_TAILS)}[l_partkey % 12 + 1] AS value FROM lineitem)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("l_partkey") % 12, F.col("l_quantity").cast("int").cast("string")
    number = F.when(F.col("l_suppkey") % 2 == 0, q).otherwise(F.concat(q, F.lit("."), F.col("l_linenumber").cast("string")))
    value = F.concat(_one_of(_HEADS, k), F.when(k == 10, "").otherwise(number), _one_of(_TAILS, k))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"), value.alias("value"))


@query("F4_parse_value", rf"""WITH {_VALUES}, p AS (SELECT id, line, part, supp, price, value, replace(replace(replace(replace(value, '−', '-'), '–', '-'), '⁻¹', '-1'), '⁻', '-') AS t FROM v),
    q AS (SELECT *, nullif(regexp_extract(t, '{_QTY}', 1), '') AS num, lower(replace(nullif(regexp_extract(t, '{_QTY}', 2), ''), ' ', '')) AS key, nullif(regexp_extract(t, '({_NUM})', 1), '') AS bare FROM p),
    u AS (SELECT *, CASE key WHEN 'ev' THEN 'eV' WHEN 'mev' THEN 'meV' WHEN 'kj/mol' THEN 'kJ/mol' WHEN 'kjmol' THEN 'kJ/mol' WHEN 'kcal/mol' THEN 'kcal/mol' WHEN 'kcalmol' THEN 'kcal/mol' WHEN 'ha' THEN 'Ha' WHEN 'ry' THEN 'Ry' WHEN 'å' THEN 'Å' WHEN 'cm-1' THEN 'cm-1' WHEN 'cm1' THEN 'cm-1' WHEN 'k' THEN 'K' ELSE key END AS unit FROM q)
    SELECT id, line, part, supp, price, value AS raw, CAST(coalesce(num, bare) AS DOUBLE) AS numeric, unit, round(CAST(num AS DOUBLE) * CASE unit WHEN 'eV' THEN 1.0::DOUBLE WHEN 'meV' THEN 0.001::DOUBLE WHEN 'kJ/mol' THEN 1.0::DOUBLE / 96.485::DOUBLE WHEN 'kcal/mol' THEN 1.0::DOUBLE / 23.061::DOUBLE WHEN 'Ha' THEN 27.2114::DOUBLE WHEN 'Ry' THEN 13.6057::DOUBLE END, 4) AS ev FROM u""")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, sf_dir).select("*", C.parse_value(F.col("value")).alias("p"))
    return rows.select("id", "line", "part", "supp", "price", "p.raw", "p.numeric", "p.unit", F.col("p.eV").alias("ev"))


_SAID = ("", "score: ", "-", "none", "I say ", "0.")
_SAYS = f"v AS (SELECT event_id AS id, CASE event_id % 7 WHEN 6 THEN NULL WHEN 3 THEN 'none' ELSE {_sql_list(_SAID)}[event_id % 7 + 1] || (user_id % 30) || CASE WHEN event_id % 2 = 0 THEN '' ELSE '.' || (event_id % 90) END END AS reply FROM events)"


@query("F7_R7_judge_score", rf"""WITH {_SAYS}, s AS (SELECT id, CASE WHEN regexp_matches(reply, '{_NUM}') THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(regexp_extract(reply, '({_NUM})', 1) AS DOUBLE))) END AS score FROM v)
    SELECT id, score, coalesce(score, 0.5::DOUBLE) AS neutral, greatest(coalesce(score, 0.0::DOUBLE), 0.5::DOUBLE) AS floored FROM s""")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' replies with a number of each event, or with none."""
    e = F.col("event_id")
    number = F.concat((F.col("user_id") % 30).cast("string"), F.when(e % 2 == 0, "").otherwise(F.concat(F.lit("."), (e % 90).cast("string"))))
    reply = F.when(e % 7 == 3, "none").when(e % 7 < 6, F.concat(_one_of(_SAID, F.least(e % 7, F.lit(5))), number))
    rows = table(spark, sf_dir, "events").select(e.alias("id"), C.judge_score(reply).alias("score"))
    return rows.select("id", "score", R.judged(F.col("score")).alias("neutral"), R.judged(F.col("score"), F.lit(0.5)).alias("floored"))


_CLOSE = "abs(l_discount - l_tax) / greatest(abs(l_tax), 0.000000001::DOUBLE)"


@query("F8_graded_closeness", f"""SELECT l_orderkey, l_linenumber, CASE WHEN {_CLOSE} <= 0.1::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - ({_CLOSE} - 0.1::DOUBLE) / (3.0::DOUBLE * 0.1::DOUBLE)) END AS graded FROM lineitem""")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.graded_closeness(F.col("l_discount"), F.col("l_tax"), 0.1).alias("graded"))


_NAMES = ("auc", "AUROC", "rmse", "error_rate", "band_gap", "yield", "", "Pearson corr", "val_loss", "top1 accuracy", "kendall tau", "energy")


def _has(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(n, '{p}')" for p in parts) + ")"


@query("F9_metric_direction", f"WITH v AS (SELECT p_partkey AS id, CASE WHEN p_size % 13 < 12 THEN {_sql_list(_NAMES)}[p_size % 13 + 1] || ' ' || p_name END AS name FROM part) SELECT id, CASE WHEN {_has(C.LOWER)} THEN 'false' WHEN {_has(C.HIGHER)} THEN 'true' END AS higher FROM (SELECT id, lower(coalesce(name, '')) AS n FROM v)")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric names beside each part's own name, which may hold a part of one as well."""
    k = F.col("p_size") % 13
    name = F.when(k < 12, F.concat(_one_of(_NAMES, F.least(k, F.lit(11))), F.lit(" "), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).select("id", C.metric_direction(F.col("name")).cast("string").alias("higher"))


# Rollouts derived from events: a metric of one of four names, a gold that is a fraction, a percentage or absent.
_ROLLOUT = """SELECT event_id, value / 100.0::DOUBLE AS v, CASE event_id % 4 WHEN 0 THEN 'auc' WHEN 1 THEN 'rmse' WHEN 2 THEN 'yield' ELSE 'pearson' END AS name, user_id % 2 = 0 AS executed,
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN (user_id % 100)::DOUBLE ELSE (user_id % 10) / 10.0::DOUBLE END AS gold FROM events"""
_METRIC = f"""WITH r AS ({_ROLLOUT}), s AS (SELECT *, CASE WHEN v IS NULL THEN false WHEN name = 'auc' THEN v BETWEEN 0 AND 100 WHEN name = 'pearson' THEN v BETWEEN -1.0001::DOUBLE AND 1.0001::DOUBLE ELSE true END AS sane,
      CASE name WHEN 'auc' THEN true WHEN 'pearson' THEN true WHEN 'rmse' THEN false END AS higher, CASE WHEN gold > 1.5 AND abs(v) <= 1.5 THEN v * 100.0::DOUBLE ELSE v END AS w,
      CASE WHEN abs(v) > 1.5 AND abs(gold) <= 1.5 THEN gold * 100.0::DOUBLE ELSE gold END AS best FROM r),
    g AS (SELECT *, CASE WHEN higher THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (w - best) / greatest(abs(best), 0.000000001::DOUBLE) AS g, abs(w - best) / greatest(abs(best), 0.000000001::DOUBLE) AS rel, gold IS NOT NULL AND v IS NOT NULL AND executed AS comparable FROM s),
    verdict AS (SELECT event_id, sane, executed AS valid, CASE WHEN comparable THEN CASE WHEN NOT sane THEN false WHEN higher IS NULL THEN abs(w - best) <= 0.1::DOUBLE * greatest(abs(best), 0.000000001::DOUBLE) ELSE g >= -0.1::DOUBLE END END AS matched,
      CASE WHEN comparable THEN CASE WHEN NOT sane THEN 0.0::DOUBLE WHEN higher IS NULL THEN CASE WHEN rel <= 0.1::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (rel - 0.1::DOUBLE) / (3.0::DOUBLE * 0.1::DOUBLE)) END
        WHEN g >= 0.1::DOUBLE THEN 1.0::DOUBLE WHEN g >= 0 THEN 0.85::DOUBLE + 0.15000000000000002::DOUBLE * (g / 0.1::DOUBLE) ELSE greatest(0.0::DOUBLE, 0.85::DOUBLE * (1.0::DOUBLE - (-g) / (3.0::DOUBLE * 0.1::DOUBLE))) END END AS graded,
      CASE WHEN comparable AND sane AND higher IS NOT NULL THEN g END AS g FROM g)"""


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = F.when(e % 4 == 0, "auc").when(e % 4 == 1, "rmse").when(e % 4 == 2, "yield").otherwise("pearson")
    gold = F.when(e % 5 == 0, None).when(e % 5 == 1, (F.col("user_id") % 100).cast("double")).otherwise((F.col("user_id") % 10) / 10.0)
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100.0).alias("v"), name.alias("name"), (F.col("user_id") % 2 == 0).alias("executed"), gold.alias("gold"))
    return rows.select("event_id", R.metric_verdict(F.col("v"), F.col("name"), F.col("executed"), F.col("gold")).alias("verdict"))


@query("R5_F10_F11_F12_metric_gate", f"{_METRIC} SELECT event_id, sane, valid, CAST(matched AS VARCHAR) AS matched, graded, g FROM verdict")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollouts(spark, sf_dir).select("event_id", F.col("verdict.matched").cast("string").alias("matched"), *(F.col(f"verdict.{c}").alias(c) for c in ("sane", "valid", "graded", "g")))


@query("R1_R8_reward", f"""{_METRIC}, scored AS (SELECT *, (event_id % 11) / 10.0::DOUBLE AS sig, (event_id % 3) / 2.0::DOUBLE AS nov, (event_id % 5) / 4.0::DOUBLE AS con, event_id % 7 = 0 AS loose FROM verdict)
    SELECT event_id, CASE WHEN matched IS NULL OR loose THEN 0.5::DOUBLE * con + 0.25::DOUBLE * sig + 0.25::DOUBLE * nov
      ELSE (CASE WHEN valid AND graded IS NOT NULL THEN graded ELSE (sane AND matched)::INT::DOUBLE END) * (0.4::DOUBLE + (0.2::DOUBLE * sig + 0.2::DOUBLE * nov + 0.2::DOUBLE * con)) END > 0.5::DOUBLE AS rewarded,
      (sane AND coalesce(matched, false))::INT::DOUBLE AS correctness, NOT (matched IS NULL OR loose) AND sane AND coalesce(matched, false) AND valid AS admissible, matched IS NULL OR loose AS unverified FROM scored""")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reward over half, as its last digits hang on each engine's rounding."""
    e = F.col("event_id")
    scores = R.reward(F.col("verdict"), (e % 11) / 10.0, (e % 3) / 2.0, (e % 5) / 4.0, e % 7 == 0)
    return _rollouts(spark, sf_dir).select("event_id", scores.alias("s")).select("event_id", (F.col("s.unrounded") > 0.5).alias("rewarded"), "s.correctness", "s.admissible", "s.unverified")


@query("R4_window_gates", """SELECT event_id, coalesce(b > 0.0 AND b < 6.0, false) AS barrier_sane, CAST(CASE WHEN gb IS NOT NULL THEN abs(b - gb) <= 0.3::DOUBLE END AS VARCHAR) AS barrier_matched, coalesce(nu > 200.0 AND nu < 4000.0, false) AS frequency_sane, abs(nu - 500.0::DOUBLE) <= 80.0::DOUBLE AS frequency_matched
    FROM (SELECT event_id, value / 10.0::DOUBLE AS b, CASE WHEN event_id % 2 = 0 THEN (user_id % 7)::DOUBLE END AS gb, value * 10.0::DOUBLE AS nu FROM events)""")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, gold = F.col("value"), F.when(F.col("event_id") % 2 == 0, (F.col("user_id") % 7).cast("double"))
    b = R.window_verdict(value / 10.0, gold, F.lit("emt"), 0.0, 6.0, 0.3)
    nu = R.window_verdict(value * 10.0, F.lit(500.0), F.lit("emt"), 200.0, 4000.0, 80.0)
    rows = table(spark, sf_dir, "events").select("event_id", b.alias("b"), nu.alias("nu"))
    return rows.select("event_id", F.col("b.sane").alias("barrier_sane"), F.col("b.matched").cast("string").alias("barrier_matched"), F.col("nu.sane").alias("frequency_sane"), F.col("nu.matched").alias("frequency_matched"))


@query("R6_gate_dispatch", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN h IN ('site_preference', 'co_adsorption_energy', 'coverage_shift') THEN 'adsorption' WHEN h = 'reaction_barrier' THEN 'barrier' WHEN h = 'vibrational_frequency' THEN 'vibration' WHEN gold IS NOT NULL THEN 'metric' ELSE 'soft' END AS kind
    FROM (SELECT CASE event_type WHEN 'view' THEN 'site_preference' WHEN 'click' THEN 'reaction_barrier' WHEN 'purchase' THEN 'vibrational_frequency' ELSE 'band_gap' END AS h, CASE WHEN event_id % 2 = 0 THEN 1 END AS gold FROM events)) GROUP BY 1""")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    handle = F.when(F.col("event_type") == "view", "site_preference").when(F.col("event_type") == "click", "reaction_barrier").when(F.col("event_type") == "purchase", "vibrational_frequency").otherwise("band_gap")
    kind = R.gate_kind(handle, F.when(F.col("event_id") % 2 == 0, 1))
    return table(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("R3_A25_match_gold", """SELECT o_custkey, count(*) AS sites, min(e) AS least, max(e) - min(e) AS spread, arg_min(site, (e, site)) AS best_site, abs(min(e) - (-1.5::DOUBLE)) <= 0.2::DOUBLE AS matched
    FROM (SELECT o_custkey, o_orderpriority AS site, min(-o_totalprice / 100000.0::DOUBLE) AS e FROM orders GROUP BY 1, 2) GROUP BY 1""")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's priorities as adsorption sites; the least energy against a gold of -1.5."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("site")).agg(F.min(-F.col("o_totalprice") / 100000.0).alias("e"))
    sites = rows.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("site", "e"))).alias("energies"), F.min_by("site", F.struct("e", "site")).alias("best_site"), (F.max("e") - F.min("e")).alias("spread"))
    matched = R.match_gold(F.col("energies"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(-1.5))
    return sites.select("o_custkey", F.size("energies").cast("bigint").alias("sites"), F.array_min(F.map_values("energies")).alias("least"), "spread", "best_site", matched.alias("matched"))


@query("J14_best_gold", """SELECT task, handle, numeric FROM (SELECT *, row_number() OVER (PARTITION BY task, handle ORDER BY ev IS NULL, numeric IS NULL, pos) AS r FROM (
    SELECT o_custkey AS task, o_orderpriority AS handle, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS numeric, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice END AS ev FROM orders)) WHERE r = 1""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("handle"), k.alias("pos"), F.when(k % 3 == 0, price).alias("numeric"), F.when(k % 6 == 0, price).alias("eV"), F.lit("").alias("claim"), F.lit("").alias("raw"), F.lit("eV").alias("unit"))
    return R.gold_for_handle(rows).select("task", "handle", "numeric")


_ENDS = """v AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'E_ads_eV: {{ontop: -' || o_custkey % 4 || '.53, fcc: -1.' || o_custkey % 100 || '}}' || chr(10) || 'site_preference: FCC' || chr(10) || 'conclusion: fcc wins ' || o_orderpriority || chr(10) || 'method: PBE' WHEN 1 THEN 'barrier_eV: 0.' || o_custkey % 100 || chr(10) || 'executed: yes'
      WHEN 2 THEN 'metric_value: -' || o_custkey % 9 || '.5' || chr(10) || 'metric_name: Top1 AUC' || chr(10) || 'executed: true' || chr(10) || 'Conclusion:  beats ' || o_orderstatus || ' ' WHEN 3 THEN 'frequency_cm1: ' || o_custkey || '.5' || chr(10) || 'executed: no' WHEN 4 THEN '' END AS answer FROM orders)""".replace("{{", "{").replace("}}", "}")


def _finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    t = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    energies = t("E_ads_eV: {ontop: -", c % 4, ".53, fcc: -1.", c % 100, "}\nsite_preference: FCC\nconclusion: fcc wins ", F.col("o_orderpriority"), "\nmethod: PBE")
    metric = t("metric_value: -", c % 9, ".5\nmetric_name: Top1 AUC\nexecuted: true\nConclusion:  beats ", F.col("o_orderstatus"), " ")
    answer = F.when(k == 0, energies).when(k == 1, t("barrier_eV: 0.", c % 100, "\nexecuted: yes")).when(k == 2, metric).when(k == 3, t("frequency_cm1: ", c, ".5\nexecuted: no")).when(k == 4, "")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), answer.alias("answer"))


def _field(p: str, group: str = "1") -> str:
    return f"nullif(regexp_extract(a, '(?i){p}', {group}), '')"


@query("F6_parse_final", f"""WITH {_ENDS} SELECT id, len(regexp_extract_all(regexp_extract(a, '(?i)E_ads_eV\\s*:\\s*\\{{([^}}]*)\\}}', 1), '([A-Za-z_\\-]+)\\s*:\\s*({_NUM})')) AS energies,
    lower({_field('site_preference\\s*:\\s*([A-Za-z_\\-]+)')}) AS site, CAST({_field(f'barrier_eV\\s*:\\s*({_NUM})')} AS DOUBLE) AS barrier, CAST({_field(f'frequency_cm1\\s*:\\s*({_NUM})')} AS DOUBLE) AS frequency,
    CAST({_field(f'metric_value\\s*:\\s*({_NUM})')} AS DOUBLE) AS metric, lower(trim({_field('metric_name\\s*:\\s*([A-Za-z0-9_\\-/ ]+)')})) AS metric_name, regexp_matches(a, '(?i)executed\\s*:\\s*(true|1|yes)\\b') AS executed,
    coalesce(trim({_field('conclusion\\s*:\\s*(.+)')}), '') AS conclusion FROM (SELECT id, coalesce(answer, '') AS a FROM v)""")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _finals(spark, sf_dir).select("id", R.parse_final(F.col("answer")).alias("f"))
    return rows.select("id", F.size("f.e_ads").cast("bigint").alias("energies"), *(F.col(f"f.{c}").alias(c) for c in ("site", "barrier", "frequency", "metric", "metric_name", "executed", "conclusion")))


_POINTS = ("Section C, issue 8 shows ", "short ", "it was done right, credit is due ", "## Credit Due (full) ", "see C.3 for ", "the agent simply ", 'it writes "no effect found" ', "stage: A planning ", "row 12 of ", "§ B-2 ", "Finding #4 ", "x: ")
#: The operator's own pattern; the flags that the other engine has no names for change nothing on ASCII texts.
_LOC = D.LOCATOR.replace("(?imdu)", "(?im)").replace("'", "''")
_CITED = f"v AS (SELECT doc_id AS id, {_sql_list(_POINTS)}[doc_id % 12 + 1] || left(regexp_replace(coalesce(text, ''), '[^a-z ]', ' ', 'g'), (doc_id % 40)::INT) AS evidence FROM documents)"


@query("T2_3_evidence", rf"""WITH {_CITED} SELECT id, length(trim(evidence)) >= 10 AS long_enough, regexp_matches(evidence, '{_LOC}') AS locatable FROM v""")
def t2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from each document's small letters, behind words that point at a place or don't."""
    key = F.col("doc_id")
    plain = F.left(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", " "), (key % 40).cast("int"))
    rows = table(spark, sf_dir, "documents").select(key.alias("id"), F.concat(_one_of(_POINTS, key % 12), plain).alias("evidence"))
    return rows.select("id", (F.length(F.trim("evidence")) >= 10).alias("long_enough"), D.locatable(F.col("evidence")).alias("locatable"))


_WHY = ("no_decision: late", "soft[x]", "timeout after 4h", "judge_unavailable", "no_computation", "")
_RUNS = f"""v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'W' ELSE 'b' END || c_custkey AS task, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || '__run' || c_custkey WHEN 1 THEN c_mktsegment WHEN 2 THEN 'm__a__b' ELSE 'codex__' END AS dir, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' & b_c 5% "x"' ELSE '' END AS tex,
      CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS cost, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS p, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS c, CASE WHEN c_custkey % 7 < 6 THEN {_sql_list(_WHY)}[c_custkey % 7 + 1] END AS reason FROM customer)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = k.cast("string")
    folder = F.when(k % 4 == 0, F.concat("c_mktsegment", F.lit("__run"), text)).when(k % 4 == 1, F.col("c_mktsegment")).when(k % 4 == 2, "m__a__b").otherwise("codex__")
    reason = F.when(k % 7 < 6, _one_of(_WHY, F.least(k % 7, F.lit(5))))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.when(k % 3 == 0, "W").otherwise("b"), text).alias("task"), folder.alias("dir"), F.concat("c_name", F.when(k % 2 == 0, ' & b_c 5% "x"').otherwise("")).alias("tex"),
        F.when(k % 5 == 0, F.col("c_acctbal")).alias("cost"), F.when(k % 7 != 0, k).alias("p"), F.when(k % 11 != 0, F.col("c_nationkey")).alias("c"), reason.alias("reason"),
    )


@query("F33_F34_F35_F36_P2_P3", f"""WITH {_RUNS} SELECT id, CASE WHEN task LIKE 'W%' THEN 'W-paper' ELSE 'named-benchmark' END AS family, split_part(dir, '__', 1) AS model,
    replace(replace(replace(replace(tex, '&', '\\&'), '_', '\\_'), '"', ''), '%', '\\%') AS latex, coalesce(cost, coalesce(p, 0) * 0.000002::DOUBLE + coalesce(c, 0) * 0.00001::DOUBLE)::DOUBLE AS usd,
    CASE WHEN reason LIKE 'judge_unavailable%' THEN 'judge_unavailable' WHEN reason LIKE 'no_decision%' THEN 'no_decision' WHEN reason LIKE 'no_computation%' THEN 'no_computation' WHEN reason LIKE 'timeout%' THEN 'timeout' ELSE 'soft' END AS category,
    coalesce(regexp_matches(reason, '^(no_decision|no_computation|timeout)'), false) AS thin FROM v""")
def f33(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir)
    category = C.reason_category(F.col("reason"), ("judge_unavailable", "no_decision", "no_computation", "timeout"))
    thin = F.coalesce(F.col("reason").rlike("^(" + "|".join(D.THIN_REASONS) + ")"), F.lit(False))
    return rows.select("id", C.task_family(F.col("task")).alias("family"), C.model_key(F.col("dir")).alias("model"), C.latex_escape(F.col("tex")).alias("latex"), C.call_cost(F.col("cost"), F.col("p"), F.col("c")).alias("usd"), category.alias("category"), thin.alias("thin"))


@query("F37_thin_scale", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity * 0.6::DOUBLE) AS INTEGER) ELSE CAST(l_quantity AS INTEGER) END AS floor_value FROM lineitem")
def f37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.thin_scale(F.col("l_quantity"), F.col("l_returnflag") == "R").alias("floor_value"))


_BEFORE = ("src/", "", "notes", "r=%.", "../", "-o", "data/", "", "a b/", "run.", "$HOME/", "0.")
_BEHIND = (".py", "", ".md", "f", "x", "", "", "", "/c", ".JSON", "", "")
_PATHS = f"v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 12 THEN repeat(p_brand, 40) || '/y' ELSE {_sql_list(_BEFORE)}[p_partkey % 13 + 1] || replace(p_brand, '#', '_') || {_sql_list(_BEHIND)}[p_partkey % 13 + 1] END AS p FROM part)"


@query("P14_paths", rf"""WITH {_PATHS} SELECT id, p <> '' AND length(p) <= 300 AND NOT regexp_matches(p, '[={{}}%()"''`$*?]') AND NOT regexp_matches(p, '^[\d.-]')
    AND (contains(p, '/') OR regexp_matches(p, '(?i)\.(py|json|jsonl|md|txt|csv|tsv|npy|npz|log|sh|ya?ml|toml|png|pdf|h5|hdf5|pkl|parquet|ipynb|c|cpp|f90|R)$')) AS path FROM v""")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's brand as a name, with and without what makes it a path."""
    k = F.col("p_partkey") % 13
    name = F.concat(_one_of(_BEFORE, F.least(k, F.lit(11))), F.replace("p_brand", F.lit("#"), F.lit("_")), _one_of(_BEHIND, F.least(k, F.lit(11))))
    p = F.when(k == 12, F.concat(F.repeat("p_brand", 40), F.lit("/y"))).otherwise(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), p.alias("p")).select("id", C.looks_like_path(F.col("p")).alias("path"))


_PLACES = ("Atop", "fcc hollow", " hcp ", "3-fold", "Bridge", "on top", "hollow")
_SITES = f"v AS (SELECT s_suppkey AS id, CASE s_suppkey % 9 WHEN 7 THEN NULL WHEN 8 THEN s_name ELSE {_sql_list(_PLACES)}[s_suppkey % 9 + 1] END AS site, ['ontop', 'FCC', 'bridge', lower(s_name)][s_suppkey % 4 + 1] AS ref FROM supplier)"


@query("F13_F17_sites", f"""WITH {_SITES} SELECT id, s AS site, lower(trim(s)) = lower(trim(ref)) AS agrees FROM (SELECT id, ref, CASE lower(trim(coalesce(site, 'ontop'))) WHEN 'atop' THEN 'ontop' WHEN 'on-top' THEN 'ontop' WHEN 'top' THEN 'ontop' WHEN 'on top' THEN 'ontop'
    WHEN 'hollow' THEN 'fcc' WHEN 'fcc-hollow' THEN 'fcc' WHEN 'fcc hollow' THEN 'fcc' WHEN 'hcp-hollow' THEN 'hcp' WHEN 'hcp hollow' THEN 'hcp' WHEN '3-fold' THEN 'fcc' ELSE lower(trim(coalesce(site, 'ontop'))) END AS s FROM v)""")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    site = F.when(k % 9 == 8, F.col("s_name")).when(k % 9 < 7, _one_of(_PLACES, F.least(k % 9, F.lit(6))))
    ref = F.when(k % 4 == 3, F.lower("s_name")).otherwise(_one_of(("ontop", "FCC", "bridge"), F.least(k % 4, F.lit(2))))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), M.site(site).alias("site"), ref.alias("ref"))
    return rows.select("id", "site", M.agrees(F.col("site"), F.col("ref"), F.lit("site"))["agrees"].alias("agrees"))


@query("F26_method_clamps", """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 3 AS wfc, l_quantity * 25 AS rho, (l_partkey % 20)::INTEGER AS k, l_discount AS d FROM lineitem),
    c AS (SELECT *, CASE WHEN wfc < 30 THEN 30.0::DOUBLE WHEN wfc > 90 THEN 90.0::DOUBLE ELSE wfc END AS w, least(greatest(k, 1), 16) AS kk FROM m), r AS (SELECT *, greatest(least(rho, 12 * w), 8 * w) AS rr FROM c)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, w AS ecutwfc, rr AS ecutrho, CASE WHEN d > 0.05 THEN 0.02::DOUBLE WHEN d < 0.002 THEN 0.01::DOUBLE ELSE d END AS degauss, kk AS k,
      concat_ws('; ', CASE WHEN wfc < 30 THEN 'ecutwfc ' || wfc::INT || '.0->30' WHEN wfc > 90 THEN 'ecutwfc ' || wfc::INT || '.0->90 (was unphysically high)' END, CASE WHEN rr <> rho THEN 'ecutrho ' || rho::INT || '.0->' || rr::INT || '.0' END,
        CASE WHEN d > 0.05 THEN 'degauss ' || d::VARCHAR || '->0.02' WHEN d < 0.002 THEN 'degauss ' || d::VARCHAR || '->0.01' END, CASE WHEN kk <> k THEN 'kpts (' || k || ', 1)->(' || kk || ', 1)' END) AS notes FROM r""", longs=("k",))
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("l_partkey") % 20).cast("int")
    m = M.clamped_method(F.col("l_quantity") * 3, F.col("l_quantity") * 25, F.lit("mv"), F.col("l_discount"), F.array(k, F.lit(1)))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "m.ecutwfc", "m.ecutrho", "m.degauss", F.col("m.kpts")[0].alias("k"), F.array_join("m.notes", "; ").alias("notes"))


_LABELS = ("compare_reference: ", "**draw conclusion** - ", "", "Run Calculation ")
_ECHOES = f"v AS (SELECT conv_id, turn, {_sql_list(_LABELS)}[turn % 4 + 1] || regexp_replace(text, '[^a-z ]', '', 'g') AS text FROM conversations)"


@query("F24_move_labels", rf"""WITH {_ECHOES} SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '(?i)^\s*\**\s*(compare[_\s]reference|draw[_\s]conclusion|run[_\s]calculation)\s*\**\s*[:\-–]?\s*', '')) AS text FROM v""")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that begin with the name of their move, spelled in some way, or don't."""
    turn = F.col("turn")
    move = _one_of(("compare_reference", "draw_conclusion", "run_calculation", "run_calculation"), turn % 4)
    said = F.concat(_one_of(_LABELS, turn % 4), F.regexp_replace("text", "[^a-z ]", ""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text"), move.alias("move")).select("conv_id", "turn", M.without_move_label(F.col("text"), F.col("move")).alias("text"))


@query("F41_F42_P23_handles", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'coverage_shift,band_gap' ELSE 'band_gap,coverage_shift' END AS observables, 'coverage_shift' AS handle, 'Given that ' || o_orderstatus || ' resolve: ' || o_orderpriority AS asked FROM orders""")
def f41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two claims of which one can be computed: every second order's second."""
    even = F.col("o_orderkey") % 2 == 0
    claim = lambda o, h, c: F.struct(F.lit(o).alias("observable"), F.lit(h).alias("recompute_handle"), c.alias("computable"))
    claims = F.array(claim("band_gap", "", F.when(even, "no").otherwise("yes")), claim("", "coverage_shift", F.when(even, "yes").otherwise("no")), claim("none", "", F.lit("yes")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", M.observables(claims).alias("o"), M.task_query(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("asked"))
    return rows.select("o_orderkey", F.array_join("o", ",").alias("observables"), M.picked_handle(F.col("o")).alias("handle"), "asked")


# Claims and tensions are first lines and whole texts of documents, so both predicates see odd white space and every language.
@query("P17_P19_claims", r"""SELECT doc_id, regexp_matches(coalesce(source, '') || ' ' || coalesce(text, ''), '(?i)\bDMC\b|\bQMC\b|diffusion monte|\bCCSD|coupled.?cluster|\bGW\b|\bRPA\b|\bMP2\b|experiment|measured|\bIR\b spectro|calorimet') AS cross_method,
    length(regexp_replace(coalesce(text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')) > 20 AS tension FROM documents""")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", P.cross_method(F.col("source"), F.col("text")).alias("cross_method"), P.real_tension(F.col("text")).alias("tension"))


@query("R9_rewarded", "SELECT event_id, coalesce(value > 10, false) AND coalesce(user_id % 3 < 2, false) AND coalesce(event_type <> 'click', false) AS rewarded FROM events")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", P.rewarded(F.col("value") > 10, F.col("user_id") % 3 < 2, F.col("event_type") != "click").alias("rewarded"))


@query("L6_gated_reconstruct", "SELECT doc_id, quality, 'lift' AS reconstruct_method, 'teacher' AS teacher_model FROM labels WHERE quality = 1 AND toxic = 0")
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return P.gated_reconstruct(rows, (F.col("quality") == 1) & (F.col("toxic") == 0), "lift", "teacher").drop("toxic")
