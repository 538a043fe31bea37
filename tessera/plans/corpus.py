"""Corpus-line and control queries over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import control as L
from tessera.operators import corpus as K
from tessera.operators import predicates as P
from tessera.operators import trees as T
from tessera.registry import query, table

# Works from parts: venue metrics from the supplier of the same number, institutions from customers.
_WORKS = """works AS (SELECT p_partkey AS work_id, CASE WHEN p_size % 5 <> 0 THEN p_size / 10.0::DOUBLE END AS fwci, p_size % 10 = 0 AS top10, p_size % 20 = 0 AS top1,
      CASE p_size % 3 WHEN 0 THEN 'journal' WHEN 1 THEN 'repository' ELSE 'conference' END AS venue_type, s_acctbal / 700.0::DOUBLE AS citedness, CASE WHEN s_suppkey IS NOT NULL THEN CAST(floor(s_acctbal / 30.0) AS INTEGER) END AS h_index,
      CASE WHEN c_custkey IS NOT NULL THEN CAST(floor(c_acctbal / 15.0) AS INTEGER) END AS institution_h_index, p_brand AS lead_institution, p_partkey % 7 AS topic
    FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 40 LEFT JOIN customer ON c_custkey = p_partkey % 500),
  flags AS (SELECT *, venue_type IN ('journal', 'conference') AS peer, coalesce(citedness >= 5, false) AS cited, coalesce(h_index >= 150, false) AS strong FROM works),
  silver AS (SELECT *, (peer AND (cited OR strong)) OR coalesce(fwci >= 1.5, false) OR top10 AS silver FROM flags),
  graded AS (SELECT *, silver AND peer AND coalesce(citedness >= 9, false) AND (coalesce(fwci >= 4, false) OR top1 OR coalesce(institution_h_index >= 400, false)) AS golden FROM silver),
  tiers AS (SELECT *, CASE WHEN golden THEN 'golden' WHEN silver THEN 'silver' ELSE 'bronze' END AS tier FROM graded)"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(key.alias("work_id"), F.when(size % 5 != 0, size / 10.0).alias("fwci"), (size % 10 == 0).alias("top10"), (size % 20 == 0).alias("top1"), F.when(size % 3 == 0, "journal").when(size % 3 == 1, "repository").otherwise("conference").alias("venue_type"), (key % 40).alias("source_id"), (key % 500).alias("institution_id"), F.col("p_brand").alias("lead_institution"), (key % 7).alias("topic"))
    venues = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 700.0).alias("two_year_citedness"), F.floor(F.col("s_acctbal") / 30.0).cast("int").alias("h_index"))
    institutions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 15.0).cast("int").alias("h_index"))
    return K.tiered(K.enriched(parts, venues, institutions))


@query("P4_P5_P6_P8_tiers", f"""WITH {_WORKS} SELECT work_id, tier, CASE tier WHEN 'golden' THEN 4.0::DOUBLE WHEN 'silver' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    (silver AND top10)::INT + (silver AND coalesce(fwci >= 1.5, false))::INT + (silver AND peer AND (cited OR strong))::INT + (golden AND top1)::INT + (golden AND coalesce(fwci >= 4, false))::INT + (golden AND coalesce(institution_h_index >= 400, false))::INT AS n_reasons FROM tiers""")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("work_id", "tier", "weight", F.size("reasons").alias("n_reasons"))


@query("A18_tier_shares", f"WITH {_WORKS} SELECT topic, tier, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY topic) AS share FROM tiers GROUP BY 1, 2")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tier_shares(works(spark, sf_dir), ["topic"])


@query("O6_golden_picks", f"WITH {_WORKS} SELECT work_id, coalesce(fwci, 0.0::DOUBLE) AS fwci FROM tiers WHERE tier = 'golden' ORDER BY 2 DESC, 1 LIMIT 40")
def o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).where("tier = 'golden'").select("work_id", F.coalesce("fwci", F.lit(0.0)).alias("fwci")).orderBy(F.desc("fwci"), "work_id").limit(40)


@query("J13_U5_first_topic", "SELECT work_id, topic_ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY topic_ord, rank) AS r FROM (SELECT l_partkey AS work_id, l_suppkey % 5 AS topic_ord, l_orderkey AS rank FROM lineitem)) WHERE r = 1")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work_id"), (F.col("l_suppkey") % 5).alias("topic_ord"), F.col("l_orderkey").alias("rank"))
    return K.first_topic(rows)


@query("J11_tier_backfill", f"WITH {_WORKS} SELECT o_orderkey, coalesce(t.tier, 'bronze') AS tier FROM orders o LEFT JOIN tiers t ON t.work_id = o.o_orderkey % 400 * 7")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as patterns; those whose key no work has are bronze."""
    known = works(spark, sf_dir).select("work_id", "tier")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 400 * 7).alias("work_id"))
    return rows.join(known, "work_id", "left").select("o_orderkey", F.coalesce("tier", F.lit("bronze")).alias("tier"))


@query("U7_candidate_urls", r"""WITH w AS (SELECT page_id, url, 'https://repo.org/' || (page_id % 50) || '.pdf' AS repo, CASE WHEN page_id % 4 = 0 THEN 'https://x.org/a.png?q=1' ELSE 'https://other.org/' || page_id END AS other, CASE WHEN page_id % 3 = 0 THEN 'PMC' || page_id END AS pmcid FROM pages),
    c AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ['https://europepmc.org/articles/PMC' || page_id || '?pdf=render'] ELSE [] END || list_filter([url, repo, other, repo], lambda u: u <> '' AND NOT regexp_matches(lower(split_part(u, '?', 1)), '\.(jpe?g|png|gif|tiff?|svg|bmp)$')) AS l FROM w)
    SELECT page_id AS work_id, len(list_distinct(l)) AS n, l[1] AS first FROM c""")
def u7(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    place = lambda u, t: F.struct(u.alias("pdf_url"), F.struct(F.lit(t).alias("type")).alias("source"))
    repo = F.concat(F.lit("https://repo.org/"), (k % 50).cast("string"), F.lit(".pdf"))
    other = F.when(k % 4 == 0, "https://x.org/a.png?q=1").otherwise(F.concat(F.lit("https://other.org/"), k.cast("string")))
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "pages").select(k.alias("work_id"), F.col("url").alias("manifest_url"), F.when(k % 3 == 0, F.concat(F.lit("PMC"), k.cast("string"))).alias("pmcid"), F.array(place(other, "journal"), place(repo, "repository")).alias("locations"), F.array(repo).alias("semantic"), none.alias("core"), F.lit(None).cast("array<string>").alias("unpaywall"))
    return K.candidate_urls(rows).select("work_id", F.size("urls").cast("bigint").alias("n"), F.col("urls")[0].alias("first"))


@query("P15_A22_fetch_totals", """SELECT coalesce(CASE WHEN o_custkey % 10 = 0 THEN 'not in id list' WHEN o_orderpriority = '5-LOW' THEN 'tier' WHEN o_totalprice > 300000 THEN 'already present' WHEN o_orderstatus <> 'O' THEN 'not open access' END, 'fetched') AS outcome, count(*) AS n FROM orders GROUP BY 1""")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetched(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("fetched")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as works, with the reason why one isn't fetched."""
    present = F.when(F.col("o_totalprice") > 300000, 2000)
    reason = K.fetch_reason(F.col("o_custkey") % 10 != 0, F.col("o_orderpriority") != "5-LOW", present, F.col("o_orderstatus") == "O")
    return table(spark, sf_dir, "orders").withColumn("reason", reason)


@query("U8_upsert", "SELECT o_orderkey, o_totalprice AS price, 'new' AS record FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 0.0::DOUBLE, 'old' FROM orders WHERE o_orderkey % 3 <> 0")
def u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    old = rows.select("o_orderkey", F.lit(0.0).alias("price"), F.lit("old").alias("record"))
    new = rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit("new").alias("record"))
    return L.upsert(old, new, ["o_orderkey"])


@query("L1_L2_L10_A16_A17_run_status", """SELECT status, count(*) AS n, sum(attempts)::BIGINT AS attempts, round(sum(cost), 2) AS spend FROM (
    SELECT CASE WHEN plan IS NOT NULL THEN plan WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'infra_error' ELSE 'failed' END WHEN event_type = 'purchase' THEN 'qa_fail' ELSE 'done' END AS status,
      before + CASE WHEN plan IS NULL AND NOT (event_type = 'error' AND event_id % 2 = 0) THEN 1 ELSE 0 END AS attempts, CASE WHEN plan IS NULL THEN (event_id % 100) / 4.0::DOUBLE ELSE 0.0::DOUBLE END AS cost
    FROM (SELECT *, user_id % 5 AS before, CASE WHEN event_id % 7 = 0 AND event_id % 49 <> 0 THEN 'skipped' WHEN event_id % 49 <> 0 AND user_id % 5 >= 3 THEN 'gave_up' END AS plan FROM events)) GROUP BY 1""")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, forced = F.col("event_id"), F.col("event_id") % 49 == 0
    rows = table(spark, sf_dir, "events").withColumn("before", F.col("user_id") % 5)
    error = F.when(F.col("event_type") == "error", F.when(e % 2 == 0, "http 503 from provider").otherwise("no JSON in reply"))
    rows = rows.withColumn("plan", L.plan_status(e % 7 == 0, forced, F.col("before"), 3))
    rows = rows.withColumn("status", F.coalesce("plan", L.result_status(error.isNull(), error, F.col("event_type") != "purchase")))
    attempts = F.when(F.col("plan").isNotNull(), F.col("before")).otherwise(L.charged_attempts(F.col("before"), F.col("status")))
    cost = F.when(F.col("plan").isNull(), (e % 100) / 4.0).otherwise(0.0)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(attempts).alias("attempts"), F.round(F.sum(cost), 2).alias("spend"))


def stand_in(ask: L.Ask) -> str:
    """A client that depends on the prompt alone: its answer needs 400 tokens a character; some prompts meet trouble first, some fail for good."""
    size = len(ask.prompt)
    if size % 13 == 5:
        raise ValueError("no JSON")
    if ask.attempt < size % 6 - 1:
        raise OSError(f"http 529 at {ask.attempt}")
    if size * 400 > ask.tokens:
        raise L.Truncated(str(ask.tokens))
    return f"{size} in {ask.tokens}"


@query("L3_L5_bounded_calls", """WITH RECURSIVE p AS (SELECT conv_id || '/' || turn AS key, length(text) AS n FROM conversations),
    go AS (SELECT key, n, 0 AS attempt, 16000 AS tokens, 0.0::DOUBLE AS waited, CASE WHEN n % 13 = 5 THEN 'bad' WHEN 0 < n % 6 - 1 THEN 'busy' WHEN n * 400 > 16000 THEN 'long' ELSE 'ok' END AS outcome FROM p
      UNION ALL SELECT key, n, attempt + 1, t, w, CASE WHEN attempt + 1 < n % 6 - 1 THEN 'busy' WHEN n * 400 > t THEN 'long' ELSE 'ok' END
      FROM (SELECT *, CASE outcome WHEN 'long' THEN least(tokens * 18 // 10, 64000) ELSE tokens END AS t, waited + CASE outcome WHEN 'busy' THEN 2.0 * (1 << attempt) ELSE 0 END AS w FROM go WHERE outcome IN ('busy', 'long') AND attempt < 3)),
    last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY attempt DESC) AS r FROM go)
    SELECT key, CASE outcome WHEN 'ok' THEN n || ' in ' || tokens END AS reply, CASE outcome WHEN 'bad' THEN 'ValueError: no JSON' WHEN 'busy' THEN 'transport: http 529 at ' || attempt WHEN 'long' THEN 'truncated: ' || tokens END AS error, attempt + 1 AS tries, tokens, waited FROM last WHERE r = 1""", longs=("tries", "tokens"))
def bounded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns asked, eight at once a task; the client doesn't make one wait."""
    turns = table(spark, sf_dir, "conversations")
    prompts = turns.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("key"), F.col("text").alias("prompt"))
    return L.call_model(prompts, stand_in, at_once=8, sleep=lambda s: None)


@query("L7_O11_admission", """SELECT stage, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(value > 10, false) THEN 'exit chain' WHEN event_type = 'view' THEN 'thoughts' WHEN user_id % 9 = 0 THEN 'physics' ELSE 'admitted' END AS stage FROM events) GROUP BY 1""")
def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.ordered_cascade(table(spark, sf_dir, "events"), [("exit chain", F.col("value") > 10), ("thoughts", F.col("event_type") != "view"), ("physics", F.col("user_id") % 9 != 0)])
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("O7_O11_first_admitted", "SELECT event_id FROM events WHERE coalesce(value > 10, false) AND event_type <> 'view' ORDER BY 1 LIMIT 25")
def o11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.ordered_cascade(table(spark, sf_dir, "events"), [("exit chain", F.col("value") > 10), ("thoughts", F.col("event_type") != "view")])
    return L.first_admitted(rows, ["event_id"], 25).select("event_id")


@query("U1_A20_union_sets", "SELECT label, priority, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS label, o_orderpriority AS priority FROM orders UNION ALL SELECT 'all', o_orderpriority FROM orders) GROUP BY 1, 2")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, and all of them as a set of their own."""
    rows = table(spark, sf_dir, "orders").withColumn("priority", F.col("o_orderpriority"))
    status = F.coalesce("o_orderstatus", F.lit(""))
    sets = {"finished": rows.where(status == "F"), "open": rows.where(status == "O"), "pending": rows.where(~status.isin("F", "O")), "all": rows}
    return K.labelled_union(sets, ["priority"])


@query("A19_A21_distribution", "SELECT coalesce(nullif(event_type, 'view'), '(none)') AS move, count(*) AS n, count(DISTINCT user_id) AS papers, row_number() OVER (ORDER BY count(*) DESC, 1) AS place FROM (SELECT coalesce(nullif(event_type, 'view'), '(none)') AS event_type, user_id FROM events) GROUP BY 1", longs=("place",))
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.distribution(table(spark, sf_dir, "events"), F.nullif("event_type", F.lit("view")), "user_id")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "move")))


@query("J15_registry_lookup", "SELECT n.n_nationkey, coalesce(r.r_name, s.n_name) AS name, r.r_name IS NOT NULL AS execution FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_nationkey LEFT JOIN nation s ON s.n_nationkey = n.n_nationkey")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registries, the first preferred: regions, then nations, by one id."""
    n = table(spark, sf_dir, "nation")
    first = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("name"))
    return P.looked_up(n.select("n_nationkey"), first, n.select("n_nationkey", F.col("n_name").alias("name")), "n_nationkey")


# Customers as nodes of a forest: each hangs below the one of half its key; those of nation 7 turn in a ring of their own, and their heirs hang on it.
_LINKS = """ring AS (SELECT c_custkey AS node, coalesce(lead(c_custkey) OVER (ORDER BY c_custkey), min(c_custkey) OVER ()) AS next FROM customer WHERE c_nationkey = 7 AND c_custkey < 400),
    links AS (SELECT c_custkey AS node, coalesce(next, CASE WHEN c_custkey > 1 THEN CASE WHEN c_custkey % 97 = 0 THEN -1 ELSE c_custkey // 2 END END) AS parent FROM customer LEFT JOIN ring ON node = c_custkey)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("nation"))
    # At most 400 nodes make the ring.
    ring, order = rows.where("nation = 7 and node < 400"), Window.partitionBy("nation")
    ring = ring.select("node", F.coalesce(F.lead("node").over(order.orderBy("node")), F.min("node").over(order)).alias("next"))
    halved = F.when(F.col("node") > 1, F.when(F.col("node") % 97 == 0, F.lit(-1)).otherwise(F.floor(F.col("node") / 2)))
    return rows.join(ring, "node", "left").select("node", F.coalesce("next", halved).cast("bigint").alias("parent"))


@query("J17_hierarchy", f"""WITH RECURSIVE {_LINKS}, walk AS (SELECT node, parent, node AS root, 0::BIGINT AS depth, [node] AS path FROM links WHERE parent IS NULL
      UNION ALL SELECT node, parent, parent, 1, [parent, node] FROM links WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM links)
      UNION ALL SELECT l.node, l.parent, w.root, w.depth + 1, list_append(w.path, l.node) FROM walk w JOIN links l ON l.parent = w.node)
    SELECT l.node, l.parent, w.root, w.depth, array_to_string(w.path, '/') AS path, w.root IS NULL AS cycle FROM links l LEFT JOIN walk w USING (node)""")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of unknown depth with missing parents, a ring and what hangs on it."""
    return T.hierarchy(links(spark, sf_dir)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query("P1_S23_allow_list", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return P.allowed(table(spark, sf_dir, "orders"), allowed, "o_custkey").select("o_orderkey")


@query("P21_P24_task_objective", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'reach_conclusion' WHEN o_orderpriority = '1-URGENT' THEN 'reproduce_or_surpass' ELSE 'reproduce' END AS objective, o_orderpriority = '2-HIGH' AS qe_ready FROM orders""")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    handle = F.when(F.col("o_orderpriority") == "1-URGENT", "test_auc").when(F.col("o_orderpriority") == "2-HIGH", "site_preference").otherwise("yield")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), handle.alias("handle"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("numeric"))
    claims = rows.select(F.col("paper_id").alias("task"), F.lit(0).alias("pos"), "handle", "numeric")
    return K.task_rows(rows.select("paper_id"), claims, claims.select("task", "handle", "numeric")).select(F.col("paper_id").alias("o_orderkey"), "objective", "qe_ready")


@query("T6_prefilter", "SELECT event_id, coalesce(value, 0.0::DOUBLE) / 10.0::DOUBLE <= 5.0::DOUBLE AND (user_id % 3 <> 0 OR abs(value - 50.0::DOUBLE) <= 20.0::DOUBLE) AS passed FROM events")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A force tolerance, and an energy deviation where a reference is given."""
    force, reference = F.coalesce("value", F.lit(0.0)) / 10.0, F.when(F.col("user_id") % 3 == 0, F.lit(50.0))
    passed = P.prefilter(force, F.col("value"), reference, 5.0, 20.0)
    return table(spark, sf_dir, "events").select("event_id", passed.alias("passed"))
