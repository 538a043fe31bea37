"""Gates, specs and claims over orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import methods as M
from tessera.functions import structures as B
from tessera.operators import corpus as K
from tessera.operators import gates as G
from tessera.operators import scoring as R
from tessera.operators import trajectories as T
from tessera.registry import query, table

_HANDLES = ("site_preference", "reaction_barrier", " vibrational_frequency ", "test_auc", "work_function")

# Orders as rollouts: five handles, reported numbers by price and customer, golds for some, specs by priority.
_ROLLOUTS = """r AS (SELECT o_orderkey AS id, o_orderkey % 5 AS h, o_custkey AS c, o_totalprice / 100000.0::DOUBLE AS p, o_orderpriority AS metal, o_custkey % 3 = 0 AS spec, o_custkey % 2 = 0 AS ran, o_orderkey % 3 AS k FROM orders),
    x AS (SELECT *, spec AND metal IN ('1-URGENT', '2-HIGH') AS again FROM r),
    v AS (SELECT *, CASE WHEN again THEN -1.25::DOUBLE ELSE -p END AS e1, CASE WHEN again THEN -1.5::DOUBLE ELSE -p - (c % 7) / 100.0::DOUBLE END AS e2, CASE WHEN again THEN 'fcc' WHEN k = 0 THEN 'ontop' END AS site, CASE WHEN again THEN 0.75::DOUBLE ELSE p * 2 END AS barrier, CASE WHEN again THEN 2050.0::DOUBLE ELSE p * 1000 END AS nu, p / 5 AS metric FROM x)"""


def rollouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rollouts, and results of the specs of two priorities."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice") / 100000.0
    spec = F.when(c % 3 == 0, F.create_map(F.lit("element"), F.col("o_orderpriority"), F.lit("facet"), F.lit("111"), F.lit("junk"), F.col("o_orderstatus")))
    reported = F.struct(F.create_map(F.lit("ontop"), -p, F.lit("fcc"), -p - (c % 7) / 100.0).alias("e_ads"), F.when(k % 3 == 0, "ontop").alias("site"), (p * 2).alias("barrier"), (p * 1000).alias("frequency"), (p / 5).alias("metric"), F.lit("AUC").alias("metric_name"), (c % 2 == 0).alias("executed"))
    gold = F.struct(F.when(k % 3 == 0, "fcc").alias("site_preference"), F.when(k % 3 == 1, -1.5).alias("energy_eV"), F.when(k % 3 != 0, 0.8).alias("barrier_eV"), F.when(k % 3 != 0, 2000.0).alias("frequency_cm1"), F.when(k % 3 != 2, 0.5).alias("numeric"))
    handle = F.element_at(F.array(*map(F.lit, _HANDLES)), (k % 5 + 1).cast("int"))
    none = F.lit(None).cast("map<string,string>")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), handle.alias("handle"), reported.alias("reported"), gold.alias("gold"), F.lit(None).cast("boolean").alias("higher_is_better"), spec.alias("system_spec"), none.alias("method_spec"), F.lit("Pd").alias("metal"))
    done = table(spark, sf_dir, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')").select("o_orderpriority").distinct()
    key = G.respec(F.create_map(F.lit("facet"), F.lit("111"), F.lit("element"), F.col("o_orderpriority")), none, F.lit(None).cast("string"))["hash"]
    return rows, done.select(key.alias("hash"), F.create_map(F.lit("ontop"), F.lit(-1.25), F.lit("fcc"), F.lit(-1.5)).alias("e_ads"), F.lit("fcc").alias("site"), F.lit(0.75).alias("barrier"), F.lit(2050.0).alias("frequency"), F.lit("qe").alias("tier"))


@query("R2_R4_R5_R6_R10_UD6_gates", f"""WITH {_ROLLOUTS}, w AS (SELECT *, CASE h WHEN 0 THEN 'adsorption' WHEN 1 THEN 'barrier' WHEN 2 THEN 'vibration' ELSE CASE WHEN k <> 2 THEN 'metric' ELSE 'soft' END END AS gate FROM v),
    s AS (SELECT *, CASE gate WHEN 'adsorption' THEN e1 > -4 AND e1 < 0.5 AND e2 > -4 AND e2 < 0.5 WHEN 'barrier' THEN barrier > 0 AND barrier < 6 WHEN 'vibration' THEN nu > 200 AND nu < 4000 WHEN 'metric' THEN metric BETWEEN 0 AND 100 ELSE true END AS sane,
      CASE gate WHEN 'adsorption' THEN abs(e1 - e2) > 0.01::DOUBLE ELSE true END AS decisive, CASE gate WHEN 'metric' THEN ran WHEN 'soft' THEN false ELSE again END AS valid,
      CASE gate WHEN 'adsorption' THEN CASE WHEN k = 0 THEN site = 'fcc' WHEN k = 1 THEN abs(least(e1, e2) + 1.5::DOUBLE) <= 0.2::DOUBLE END WHEN 'barrier' THEN CASE WHEN k <> 0 THEN abs(barrier - 0.8::DOUBLE) <= 0.3::DOUBLE END WHEN 'vibration' THEN CASE WHEN k <> 0 THEN abs(nu - 2000.0::DOUBLE) <= 80.0::DOUBLE END
        WHEN 'metric' THEN CASE WHEN ran THEN (metric - 0.5::DOUBLE) / 0.5::DOUBLE >= -0.1::DOUBLE END END AS matched FROM w)
    SELECT id, gate, CASE gate WHEN 'soft' THEN 'soft-only' WHEN 'metric' THEN 'metric-repro' ELSE CASE WHEN again THEN 'reexecute' ELSE 'trust-reported' END END AS mode, sane, decisive, valid, matched::VARCHAR AS matched,
      CASE gate WHEN 'soft' THEN false WHEN 'metric' THEN sane AND decisive AND coalesce(valid AND matched, false) ELSE sane AND decisive AND coalesce(matched, true) END AS correct FROM s""")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders through their own gate; what has been re-executed replaces what was reported."""
    rows, done = rollouts(spark, sf_dir)
    v = G.verdicts(rows, done)
    return v.select("id", "gate", "mode", "verdict.sane", "verdict.decisive", "verdict.valid", F.col("verdict.matched").cast("string").alias("matched"), "verdict.correct")


_METALS = ("Pt", "Fe", "Co", "Xx", "Cu", "")
_SUPPORTS = ("graphene", "Rutile TiO2", "CeO2", "zirconium oxide", "carbon", "", "tio2")


@query("F43_structure_clamps", f"""WITH s AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'supported' ELSE 'slab' END AS kind, {list(_METALS)}[p_partkey % 6 + 1] AS element, ['111', '0001', 'edge'][p_size % 3 + 1] AS facet, {list(_SUPPORTS)}[p_partkey % 7 + 1] AS support, CASE WHEN p_size % 2 = 0 THEN 'Vacancy' ELSE 'odd' END AS defect, p_size % 5 AS cells, p_size % 6 AS layers FROM part),
    f AS (SELECT *, CASE WHEN element IN ('Pt', 'Cu', '') THEN 'fcc' WHEN element = 'Fe' THEN 'bcc' WHEN element = 'Co' THEN 'hcp' ELSE 'fcc' END AS cr, lower(support) AS sup FROM s),
    g AS (SELECT *, kind = 'slab' AS slab, CASE cr WHEN 'hcp' THEN facet = '0001' ELSE facet = '111' END AS built, CASE cr WHEN 'hcp' THEN '0001' ELSE '111' END AS usual, CASE WHEN sup = 'tio2' THEN 'tio2' WHEN contains(sup, 'rutile') THEN 'tio2' WHEN sup = 'ceo2' THEN 'ceo2' WHEN contains(sup, 'oxide') THEN 'ceo2' ELSE 'graphene' END AS target FROM f),
    b AS (SELECT *, NOT slab AND target <> 'graphene' AS oxide, CASE WHEN layers = 0 THEN 3 ELSE layers END AS l FROM g)
    SELECT id, CASE WHEN slab AND element = 'Xx' THEN 'Pt' ELSE element END AS element, CASE WHEN slab AND NOT built THEN usual ELSE facet END AS facet, CASE WHEN slab THEN support ELSE target END AS support, CASE WHEN NOT slab AND target = 'graphene' AND defect = 'odd' THEN 'vacancy' ELSE defect END AS defect,
      CASE WHEN oxide THEN '1,1' WHEN slab THEN least(cells, 2) || ',2' ELSE CASE WHEN cells > 3 THEN '3,2' ELSE cells || ',2' END END AS supercell, CASE WHEN slab AND l > 4 THEN 4 WHEN slab AND l < 2 THEN 2 ELSE layers END AS layers,
      array_to_string(list_filter([CASE WHEN slab AND element = 'Xx' THEN 'metal ''Xx'' has no wired crystal → Pt(111)' END, CASE WHEN slab AND NOT built THEN 'facet ''' || facet || '''→' || usual || ' (not wired for ' || cr || ')' END,
        CASE WHEN slab OR sup IN ('tio2', 'ceo2') THEN NULL WHEN contains(sup, 'rutile') THEN 'support ''rutile tio2''→tio2 (wired oxide preset)' WHEN contains(sup, 'oxide') THEN 'oxide support ''' || sup || '''→ceo2 (nearest wired preset)' WHEN sup <> 'graphene' THEN 'support ''' || CASE WHEN sup = '' THEN 'none' ELSE sup END || '''→graphene (only wired carbon support)' END,
        CASE WHEN NOT slab AND target = 'graphene' AND defect = 'odd' THEN 'defect ''odd''→vacancy' END, CASE WHEN oxide THEN CASE WHEN cells <> 1 OR true THEN 'oxide supercell→(1,1) for real-DFT budget' END WHEN slab THEN CASE WHEN cells > 2 THEN 'supercell capped to (2, 2) for real-DFT budget' END WHEN cells > 3 THEN 'supercell capped to (3, 2)' END,
        CASE WHEN slab AND l > 4 THEN 'layers capped to 4' END, CASE WHEN slab AND l < 2 THEN 'layers 1→2 (1-layer slab freezes all atoms, no forces)' END], lambda n: n IS NOT NULL), '; ') AS notes, CASE WHEN id % 4 = 0 THEN 'CH3OH' ELSE 'CO' END AS adsorbate FROM b""", longs=("layers",))
def structure_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as specs: metals, facets, supports and sizes that can't be built or paid for."""
    size, key = F.col("p_size"), F.col("p_partkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    specs = table(spark, sf_dir, "part").select(
        key.alias("id"), F.when(size % 3 == 0, "supported").otherwise("slab").alias("kind"), pick(_METALS, key % 6).alias("element"), pick(("111", "0001", "edge"), size % 3).alias("facet"), pick(_SUPPORTS, key % 7).alias("support"),
        F.when(size % 2 == 0, "Vacancy").otherwise("odd").alias("defect"), F.array((size % 5).cast("int"), F.lit(2)).alias("supercell"), (size % 6).cast("int").alias("layers"), F.when(key % 4 == 0, " CH3OH ").when(key % 4 == 1, "CO*").when(key % 4 == 2, "Qq2").alias("adsorbate"),
    )
    done = B.clamped_structures(specs, 2, 4, budget=True)
    return done.select("id", "element", "facet", "support", "defect", F.array_join(F.col("supercell").cast("array<string>"), ",").alias("supercell"), "layers", F.array_join("notes", "; ").alias("notes"), "adsorbate")


@query("P16_F5_claims", """WITH c AS (SELECT p_partkey AS task, CASE p_size % 4 WHEN 0 THEN 'band gap' WHEN 1 THEN '' WHEN 2 THEN 'none' END AS o, CASE WHEN p_size % 3 = 0 THEN ' energy ' WHEN p_size % 3 = 1 THEN 'None' END AS h, p_retailprice::VARCHAR AS v, CASE p_size % 2 WHEN 0 THEN 'eV' ELSE '' END AS u FROM part),
    n AS (SELECT *, trim(coalesce(nullif(o, ''), h, '')) AS handle FROM c)
    SELECT task, handle, CASE WHEN u = '' THEN v ELSE v || ' ' || u END AS raw, v::DOUBLE AS numeric, nullif(u, '') AS unit FROM n WHERE handle <> '' AND lower(handle) <> 'none'""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of all parts: those with a handle, by its new or old name, with value and unit put together."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"), F.lit(0).alias("pos"), F.when(size % 4 == 0, "band gap").when(size % 4 == 1, "").when(size % 4 == 2, "none").alias("observable"), F.when(size % 3 == 0, " energy ").when(size % 3 == 1, "None").alias("recompute_handle"), F.lit("c").alias("claim"), F.col("p_retailprice").cast("string").alias("value"), F.when(size % 2 == 0, "eV").otherwise("").alias("unit"))
    return R.claim_records(rows).select("task", "handle", "raw", "numeric", "unit")


@query("F18_flat_params", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'CONTROL.k=' || l_quantity::INT || ' SYSTEM.ecut=' || l_partkey || ' SYSTEM.k=' || l_suppkey AS flat, 'ecut=' || l_partkey || ' k=' || l_suppkey AS leaves FROM lineitem""")
def flat_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested parameters of each line item as SECTION.key, and as leaves of which a later section's wins."""
    s = lambda c: F.col(c).cast("string")
    nested = F.create_map(F.lit("CONTROL"), F.create_map(F.lit("k"), F.col("l_quantity").cast("int").cast("string")), F.lit("SYSTEM"), F.create_map(F.lit("ecut"), s("l_partkey"), F.lit("k"), s("l_suppkey")))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", shown(T.flatten_params(nested)).alias("flat"), shown(T.leaf_params(nested)).alias("leaves"))


@query("F25_F27_F39_methods", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '(no prior context)' WHEN 1 THEN '- goal: ' || p_name ELSE '- goal: ' || p_name || chr(10) || '- method: ' || p_brand END AS context, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'HUBBARD (ortho-atomic)|U Fe-3d ' || p_size || '.0' END AS cards,
    CASE p_size % 4 WHEN 1 THEN 'no Hubbard manifold known for Xx' END AS error, CASE p_size % 2 WHEN 0 THEN p_size ELSE p_size + 1 END AS iterations FROM part""", longs=("iterations",))
def method_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context views, cards and iteration counts of parts."""
    size = F.col("p_size")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    context = F.when(size % 3 == 0, empty).when(size % 3 == 1, F.create_map(F.lit("goal"), F.col("p_name"), F.lit("tension"), F.lit(""))).otherwise(F.create_map(F.lit("method"), F.col("p_brand"), F.lit("zzz"), F.lit("no"), F.lit("goal"), F.col("p_name")))
    u = F.when(size % 4 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).when(size % 4 == 1, F.create_map(F.lit("Xx"), F.lit(1.0))).otherwise(F.create_map(F.lit("Fe"), size.cast("double")))
    count = F.expr("parse_json(case when p_size % 2 = 0 then cast(p_size as string) else concat('[1, ', p_size, ', ', p_size + 1, ']') end)")
    rows = table(spark, sf_dir, "part").select("p_partkey", M.context_view(context).alias("context"), M.hubbard_cards(u).alias("h"), M.scf_iterations(count).alias("iterations"))
    return rows.select("p_partkey", "context", F.array_join("h.cards", "|").alias("cards"), "h.error", "iterations")


@query("S24_pdf_checks", "SELECT page_id, page_id % 2 = 0 AND length(html) + 4 <= 5000 AS ok FROM (SELECT page_id, coalesce(regexp_replace(html, '[^ -~]', 'x', 'g'), '') AS html FROM pages)")
def pdf_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bodies of fetched files: each second begins as a PDF, and long ones are over the cap."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), "[^ -~]", "x")
    body = F.concat(F.when(F.col("page_id") % 2 == 0, "%PDF").otherwise("<htm"), plain).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", K.pdf_ok(body, most=5000).alias("ok"))
