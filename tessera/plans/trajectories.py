"""Trajectory queries: ``lineitem`` rows as steps of an order, ``conversations`` as event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import episodes as E
from tessera.operators import logs as L
from tessera.operators import predicates as P
from tessera.operators import trajectories as T
from tessera.registry import query, table

# A step of an order: R is a failed exit, O an unknown one, N (with F) a killed run; mode of shipping gives moves.
_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_STEPS = f"""steps AS (SELECT l_orderkey AS trajectory_id, {_PLACE} AS idx, CASE l_returnflag WHEN 'R' THEN 400 WHEN 'A' THEN NULL ELSE 0 END AS exit_status,
    CASE WHEN l_quantity > 45 THEN 'killed' WHEN l_quantity > 5 THEN 'finished' END AS state, l_quantity AS q, l_partkey AS p FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered within their order: the line number alone repeats."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(order))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("trajectory_id"), F.col("place").alias("index"), F.when(flag == "R", 400).when(flag != "A", 0).alias("exit_status"), F.when(q > 45, "killed").when(q > 5, "finished").alias("state"), q.alias("q"), F.col("l_partkey").alias("p"))
    return rows.withColumns({"exception": F.lit(None).cast("string"), "correction": F.when(F.col("p") % 50 == 0, "c")})


_OK = "NOT coalesce(exit_status <> 0, false) AND NOT coalesce(state <> 'finished', false)"


@query("IR_P11_A24_summaries", f"""WITH {_STEPS} SELECT trajectory_id, count(*) AS steps, arg_max({_OK}, idx) AS succeeded, bool_or(coalesce(exit_status <> 0, false) OR coalesce(state IN ('excepted', 'killed'), false) OR p % 50 = 0) AS any_failure,
    coalesce(max(CASE WHEN idx = last THEN exit_status END) = 0 AND bool_or(idx < last AND coalesce(exit_status <> 0, false)), false) AS recovery FROM (SELECT *, max(idx) OVER (PARTITION BY trajectory_id) AS last FROM steps) GROUP BY 1""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.summaries(steps(spark, sf_dir)).drop("exits")


@query("A23_P10_admissible", """SELECT o_orderkey, list_filter([o_orderkey % 2 = 0, o_custkey % 3 = 0, o_totalprice > 150000], lambda v: v).len() AS votes_for,
    o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND list_filter([o_orderkey % 2 = 0, o_custkey % 3 = 0, o_totalprice > 150000], lambda v: v).len() >= 2 AS admissible FROM orders""")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = F.array(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 3 == 0, F.col("o_totalprice") > 150000)
    ok = T.admissible(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 5 != 0, votes, F.lit(2))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(F.filter(votes, lambda v: v)).cast("bigint").alias("votes_for"), ok.alias("admissible"))


_MOVES = """moves AS (SELECT conv_id AS traj_id, turn AS idx, CASE role WHEN 'system' THEN 'survey_consensus' WHEN 'user' THEN 'run_calculation:x' ELSE CASE WHEN turn % 4 = 0 THEN 'formulate_question' ELSE 'draw_conclusion' END END AS move,
    CASE WHEN length(text) % 3 = 0 THEN 'we conclude ' ELSE '' END AS thought FROM conversations)"""


@query("T3_W8_W9_arc_lint", f"""WITH {_MOVES}, s AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY traj_id) AS n,
      CASE split_part(move, ':', 1) WHEN 'survey_consensus' THEN 'FRAME' WHEN 'formulate_question' THEN 'FRAME' WHEN 'run_calculation' THEN 'PROBE' WHEN 'draw_conclusion' THEN 'RESOLVE' END AS phase FROM moves),
    t AS (SELECT *, coalesce(bool_or(phase IN ('PROBE', 'RESOLVE')) OVER (PARTITION BY traj_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone,
      coalesce(min(CASE WHEN phase = 'PROBE' THEN place END) OVER (PARTITION BY traj_id), n) AS calc FROM s)
    SELECT traj_id, sum((place = 0 AND NOT starts_with(move, 'survey_consensus'))::INT + (place = n - 1 AND NOT starts_with(move, 'draw_conclusion'))::INT + (phase = 'FRAME' AND gone)::INT + (place < least(calc, n - 1) AND contains(thought, 'we conclude'))::INT)::BIGINT AS problems FROM t GROUP BY 1""")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = F.when(F.col("role") == "system", "survey_consensus").when(F.col("role") == "user", "run_calculation:x").when(F.col("turn") % 4 == 0, "formulate_question").otherwise("draw_conclusion")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("idx"), move.alias("move"), F.when(F.length("text") % 3 == 0, "we conclude ").otherwise("").alias("thought"), F.lit("").alias("observation"))
    return T.arc_problems(rows).select("traj_id", F.size("problems").cast("bigint").alias("problems"))


@query("T4_thought_lint", f"""WITH {_STEPS}, s AS (SELECT *, CASE WHEN p % 40 = 0 THEN 'converged' WHEN p % 41 = 0 THEN '' ELSE 'lower mixing' END AS th, max(idx) OVER (PARTITION BY trajectory_id) AS last FROM steps)
    SELECT trajectory_id, coalesce(max(CASE WHEN idx = last THEN exit_status END) = 0 AND bool_or(idx < last AND coalesce(exit_status <> 0, false)), false) AND bool_and(th <> '' AND NOT (coalesce(exit_status <> 0, false) AND th = 'converged')) AS ok FROM s GROUP BY 1""")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    thought = F.when(F.col("p") % 40 == 0, "Converged").when(F.col("p") % 41 != 0, "lower mixing")
    return T.thought_lint(steps(spark, sf_dir).withColumns({"thought": thought, "text": F.lit("no energy")}))


@query("T5_scientist_lint", f"""WITH {_STEPS}, s AS (SELECT *, max(idx) OVER w AS last, min(idx) OVER w AS first, CASE WHEN p % 40 = 0 THEN 'it converged' WHEN p % 41 = 0 THEN '' WHEN p % 7 = 0 THEN 'resuming the run' ELSE 'lower mixing' END AS th FROM steps WINDOW w AS (PARTITION BY trajectory_id)),
    r AS (SELECT *, CASE WHEN th = '' THEN 'step' || idx || ': empty thought' WHEN coalesce(exit_status <> 0, false) AND th = 'it converged' THEN 'step' || idx || ': claims convergence on a FAILED step' WHEN idx = first AND th = 'resuming the run' THEN 'step0: treats the first action as a restart' END AS reason FROM s)
    SELECT trajectory_id, CASE WHEN NOT coalesce(max(CASE WHEN idx = last THEN exit_status END) = 0 AND bool_or(idx < last AND coalesce(exit_status <> 0, false)), false) THEN 'not a real error→recovery chain' ELSE coalesce(arg_min(reason, idx) FILTER (reason IS NOT NULL), 'ok') END AS reason FROM r GROUP BY 1""")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    thought = F.when(p % 40 == 0, "It converged").when(p % 41 == 0, None).when(p % 7 == 0, "resuming the run").otherwise("lower mixing")
    return T.scientist_lint(steps(spark, sf_dir).withColumn("thought", thought)).drop("ok")


_PARAMS = f"l_orderkey AS chain_id, {_PLACE} AS idx, 0.1::DOUBLE * (1 + l_partkey % 3) AS beta, l_suppkey % 4 AS bands, l_quantity::INT % 2 AS mode"


@query("W6_F19_F20_restart_moves", f"""WITH s AS (SELECT {_PARAMS} FROM lineitem), d AS (SELECT *, lag(beta) OVER w AS b0, lag(bands) OVER w AS n0, lag(mode) OVER w AS m0, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY chain_id ORDER BY idx))
    SELECT chain_id, idx, CASE WHEN r = 1 THEN 'run_scf' WHEN beta = b0 AND bands = n0 AND mode = m0 THEN 'restart_from_charge_density' WHEN beta < b0 THEN 'damp_charge_mixing' WHEN bands > n0 THEN 'add_empty_bands' WHEN beta = b0 AND bands = n0 THEN 'restart_from_charge_density' ELSE 'adjust_scf_parameters' END AS move,
      CASE WHEN r = 1 OR (beta = b0 AND bands = n0) THEN 0 WHEN beta < b0 OR bands > n0 THEN 1 ELSE (beta <> b0)::INT + (bands <> n0)::INT + (mode <> m0)::INT END AS n_params FROM d""", longs=("idx",))
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parameters of a line item as a run's; each line restarts the one before it."""
    beta = F.element_at(F.array(F.lit("0.1"), F.lit("0.2"), F.lit("0.3")), (F.col("l_partkey") % 3 + 1).cast("int"))
    params = F.create_map(F.lit("mixing_beta"), beta, F.lit("nbnd"), (F.col("l_suppkey") % 4).cast("string"), F.lit("restart_mode"), (F.col("l_quantity").cast("int") % 2).cast("string"))
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("chain_id"), F.col("place").alias("idx"), params.alias("params"))
    return T.lift_restarts(rows).select("chain_id", "idx", "move", F.size("params").alias("n_params"))


@query("F21_observation_text", f"""WITH {_STEPS} SELECT trajectory_id, idx, CASE WHEN exit_status = 0 THEN 'Observation: SCF converged' || CASE WHEN p % 9 <> 0 THEN ' in ' || (p % 9) || ' iterations' ELSE '' END || '; total energy = ' || printf('%.4f', q) || ' eV.'
    ELSE 'Observation: SCF did NOT converge (exit_status=' || coalesce(CAST(exit_status AS VARCHAR), 'None') || '); the run terminated' || CASE WHEN p % 9 <> 0 THEN ' after ' || (p % 9) || ' iterations' ELSE '' END || ' without producing a converged ground-state energy.' END AS text FROM steps""", longs=("idx",))
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("trajectory_id", F.col("index").alias("idx"), T.diagnosed_text(F.col("exit_status"), F.col("q"), F.col("p") % 9).alias("text"))


@query("W13_F22_F23_chat_messages", f"""WITH {_STEPS}, m AS (SELECT trajectory_id, 2 * idx AS place, 'assistant' AS role, CASE WHEN p % 3 = 0 THEN 'Thought: t' || p || chr(10) ELSE '' END || 'Action: run_scf({{"part": "' || p || '", "q": "' || CAST(q AS INTEGER) || '"}})' AS content FROM steps
      UNION ALL SELECT trajectory_id, 2 * idx + 1, 'tool', CASE WHEN p % 2 = 0 THEN 'seen ' || p WHEN coalesce(exit_status <> 0, false) THEN 'Observation: [error exit_status=400 late]' ELSE 'Observation:' END FROM steps
      UNION ALL SELECT DISTINCT trajectory_id, 0, 'system', 'sys' FROM steps UNION ALL SELECT DISTINCT trajectory_id, 1, 'user', 'goal ' || trajectory_id FROM steps
      UNION ALL SELECT trajectory_id, 1000, 'assistant', 'Final Answer: ' || CASE WHEN arg_max({_OK}, idx) THEN 'Completed successfully.' ELSE 'Run did not converge cleanly: late.' END FROM steps GROUP BY 1)
    SELECT trajectory_id, array_to_string(list(role || ': ' || content ORDER BY place), ' | ') AS messages, array_to_string(list(CASE role WHEN 'assistant' THEN '1' ELSE '0' END ORDER BY place), '') AS mask FROM m GROUP BY 1""")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat(spark, sf_dir)
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), " | ")
    return rows.select("trajectory_id", joined.alias("messages"), F.array_join(F.transform("loss_mask", lambda x: x.cast("string")), "").alias("mask"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chats."""
    s = steps(spark, sf_dir).withColumns({"name": F.lit("run_scf"), "thought": F.when(F.col("p") % 3 == 0, F.concat(F.lit("t"), F.col("p").cast("string"))), "params": F.create_map(F.lit("q"), F.col("q").cast("int").cast("string"), F.lit("part"), F.col("p").cast("string")), "text": F.when(F.col("p") % 2 == 0, F.concat(F.lit("seen "), F.col("p").cast("string"))), "exit_message": F.lit("late")})
    heads = s.select("trajectory_id").distinct().select("trajectory_id", F.lit("sys").alias("system_prompt"), F.concat(F.lit("goal "), F.col("trajectory_id").cast("string")).alias("goal"))
    return T.chat_messages(heads, s)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _logs(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """Conversations as logs: one line a turn, in order."""
    rows = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("log_id"), F.struct("turn", line.alias("line")).alias("l"))
    return rows.groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("body"))


def _json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns are tool calls, the assistant turn behind one is its result, system turns are a banner that isn't JSON."""
    turn = F.col("turn")
    call = F.struct(F.lit("tool_use").alias("type"), turn.cast("string").alias("id"), F.lit("Bash").alias("name"), F.struct(F.col("text").alias("command")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), (turn - 1).cast("string").alias("tool_use_id"), F.col("text").alias("content"))
    message = lambda x: F.struct(F.array(x).alias("content"))
    line = F.when(F.col("role") == "user", _json(type="assistant", message=message(call))).when(F.col("role") == "assistant", _json(type="user", message=message(result)))
    return _logs(spark, sf_dir, F.coalesce(line, F.lit("banner")))


@query("W1_F32_timeline_of_calls", """SELECT conv_id::VARCHAR AS log_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, 'Bash' AS name,
    CASE WHEN coalesce(text, '') = '' THEN '{"command":""}' ELSE replace(left(text, 160), chr(10), ' ') END AS shown FROM conversations WHERE role = 'user'""", longs=("idx",))
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.timeline(L.tool_events(_calls(spark, sf_dir)))


@query("J4_paired_results", """SELECT u.conv_id::VARCHAR AS log_id, u.turn::VARCHAR AS uid, coalesce(a.text, '') AS result FROM conversations u
    LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tool_events(_calls(spark, sf_dir)).where("kind = 'tool'").select("log_id", "uid", "result")


@query("W4_S6_S7_json_lines", "SELECT conv_id::VARCHAR AS log_id, count(*) AS n, min(turn) AS first FROM conversations WHERE role <> 'system' GROUP BY 1", longs=("first",))
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banner lines go; what stays keeps its place in the file."""
    first = _turns(spark, sf_dir).groupBy(F.col("conv_id").cast("string").alias("log_id")).agg(F.min("turn").alias("begin"))
    rows = L.json_lines(_calls(spark, sf_dir)).groupBy("log_id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    return rows.join(first, "log_id").select("log_id", "n", (F.col("line") + F.col("begin")).alias("first"))


@query("W3_L_P2_assistant_text", """SELECT conv_id::VARCHAR AS log_id, string_agg(t, chr(10) ORDER BY island) AS text FROM (SELECT conv_id, island, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t FROM (
    SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations) WHERE role = 'assistant' GROUP BY 1, 2) GROUP BY 1""")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are deltas, user turns are tool calls between them."""
    text = F.coalesce("text", F.lit(""))
    call = _json(type="tool_use", tool_id=F.col("turn").cast("string"), tool_name="glob", parameters=F.struct(F.lit("p").alias("pattern")))
    line = F.when(F.col("role") == "assistant", _json(type="message", role="assistant", content=text)).when(F.col("role") == "user", call).otherwise(_json(type="init", session_id="s"))
    return L.assistant_text(L.tool_events(_logs(spark, sf_dir, line)))


@query("J5_started_completed", """SELECT u.conv_id::VARCHAR AS log_id, u.turn::VARCHAR AS uid, CASE WHEN a.turn % 4 = 0 THEN coalesce(a.text, '') ELSE coalesce(u.text, '') END AS command
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns start commands, assistant turns complete them, each second one with a command of its own."""
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    item = lambda i, command: F.struct(i.cast("string").alias("id"), F.lit("command_execution").alias("type"), command.alias("command"))
    line = F.when(F.col("role") == "user", _json(type="item.started", item=item(turn, text)))
    line = line.when(F.col("role") == "assistant", _json(type="item.completed", item=item(turn - 1, F.when(turn % 4 == 0, text))))
    rows = L.codex2_events(_logs(spark, sf_dir, F.coalesce(line, _json(type="thread.started", thread_id="t"))))
    asked = _turns(spark, sf_dir).where("role = 'user'").select(F.col("conv_id").cast("string").alias("log_id"), F.col("turn").cast("string").alias("uid"))
    return rows.join(asked, ["log_id", "uid"], "left_semi").select("log_id", "uid", F.expr("try_variant_get(try_parse_json(params), '$.command', 'string')").alias("command"))


@query("W15_first_seen", "SELECT user_id::VARCHAR AS log_id, event_type AS path, min(event_id) AS first, string_agg(DISTINCT CASE event_id % 2 WHEN 0 THEN 'Edit' ELSE 'Write' END, ',' ORDER BY CASE event_id % 2 WHEN 0 THEN 'Edit' ELSE 'Write' END) AS channels FROM events GROUP BY 1, 2")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    writes = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("log_id"), F.struct(e.alias("line"), F.lit(0).alias("pos")).alias("seq"), F.lit(0).alias("n"), F.col("event_type").alias("path"), F.when(e % 2 == 0, "Edit").otherwise("Write").alias("channel"))
    return L.written_paths(writes).select("log_id", "path", F.col("first.seq.line").alias("first"), F.array_join("channels", ",").alias("channels"))


@query("J4_last_write_wins", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.last_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], "value")


@query("P25_faithful", """SELECT trajectory_id, bool_and(a.exit IS NOT NULL AND a.exit = s.exit) AS faithful FROM (SELECT l_orderkey AS trajectory_id, l_suppkey AS node, l_linenumber % 2 AS exit FROM lineitem) s
    LEFT JOIN (SELECT s_suppkey AS node, s_suppkey % 2 AS exit FROM supplier WHERE s_acctbal > 0) a USING (node) GROUP BY 1""")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps_ = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trajectory_id"), F.col("l_suppkey").alias("node"), (F.col("l_linenumber") % 2).alias("exit"))
    archive = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 2).alias("archived"))
    return P.faithful(steps_, archive)


@query("J12_chain_links", "WITH n AS (SELECT l_orderkey, l_partkey, " + _PLACE + " AS place FROM lineitem) SELECT a.l_orderkey AS chain, a.place AS parent, b.place AS child, a.l_partkey = b.l_partkey AS same_input FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND b.place = a.place + 1", longs=("parent", "child"))
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chain_links(lines(spark, sf_dir).select(F.col("l_orderkey").alias("chain"), "place", F.col("l_partkey").alias("input")))


@query("A26_max_norm", "SELECT label, round(max(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS longest, count(*) AS n FROM embeddings GROUP BY 1")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.max(P.norm(F.col("embedding"))), 6).alias("longest"), F.count(F.lit(1)).alias("n"))


# A turn as a move: the planned one of its place, none given, a wrong one or a reset, by the length of its text.
_PLAN_SQL = "[" + ", ".join(f"'{m}'" for m in E.PLAN) + "]"
_EPISODES = f"""actions AS (SELECT conv_id AS episode, turn AS idx, CASE WHEN length(text) % 17 = 1 THEN 'reset' WHEN length(text) % 6 = 0 THEN 'interpret_result' WHEN turn % 3 <> 0 THEN {_PLAN_SQL}[turn % 8 + 1] END AS move,
      role = 'assistant' AS rewarded FROM conversations),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY idx, move NULLS FIRST) AS place FROM actions),
    walk AS (SELECT episode, place, 0 AS phase, CASE WHEN move = 'reset' THEN 0 WHEN move IS NULL OR move = {_PLAN_SQL}[1] THEN 1 ELSE 0 END AS after FROM numbered WHERE place = 1
      UNION ALL SELECT n.episode, n.place, w.after, CASE WHEN n.move = 'reset' THEN 0 WHEN w.after = 8 THEN 8 WHEN n.move IS NULL OR n.move = {_PLAN_SQL}[w.after + 1] THEN w.after + 1 ELSE w.after END
      FROM walk w JOIN numbered n ON n.episode = w.episode AND n.place = w.place + 1)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, turn = F.length("text"), F.col("turn")
    planned = F.element_at(F.array(*map(F.lit, E.PLAN)), (turn % 8 + 1).cast("int"))
    move = F.when(size % 17 == 1, "reset").when(size % 6 == 0, "interpret_result").when(turn % 3 != 0, planned)
    return _turns(spark, sf_dir).select(F.col("conv_id").alias("episode"), turn.alias("idx"), move.alias("move"), (F.col("role") == "assistant").alias("rewarded"))


@query("L8_W17_episodes", f"""WITH RECURSIVE {_EPISODES} SELECT n.episode, n.idx, n.move, w.phase, {_PLAN_SQL}[w.phase + 1] AS expected,
      coalesce(n.move = 'reset', false) OR w.after <> w.phase AS accepted,
      CASE WHEN n.move = 'reset' THEN NULL WHEN w.phase = 8 THEN 'episode already terminated; call reset()' WHEN w.after = w.phase THEN 'expected move ' || chr(39) || {_PLAN_SQL}[w.phase + 1] || chr(39) || ', got ' || chr(39) || n.move || chr(39) END AS reason,
      CASE WHEN w.phase = 7 AND w.after = 8 AND n.rewarded THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, w.phase = 7 AND w.after = 8 AS done, {_PLAN_SQL}[w.after + 1] AS next_move
    FROM walk w JOIN numbered n USING (episode, place)""")
def l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns through the guarded machine: a refused one doesn't move it."""
    return E.replay_episodes(actions(spark, sf_dir))


_RECORDS = """records AS (SELECT conv_id AS paper_id, turn AS idx, ['survey_consensus', 'run_calculation:dft', 'other:look', 'compare_reference', 'draw_conclusion'][length(text) % 5 + 1] AS move,
      CASE WHEN role <> 'system' THEN left(text, 20) END AS thought, CASE WHEN role = 'assistant' THEN 'd' || turn END AS computes, coalesce(text, '') AS observation FROM conversations)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = F.element_at(F.array(*map(F.lit, ("survey_consensus", "run_calculation:dft", "other:look", "compare_reference", "draw_conclusion"))), (F.length("text") % 5 + 1).cast("int"))
    args = F.when(F.col("role") == "assistant", F.create_map(F.lit("computes"), F.concat(F.lit("d"), F.col("turn").cast("string"))))
    return _turns(spark, sf_dir).select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("idx"), moves.alias("move"), F.when(F.col("role") != "system", F.left("text", F.lit(20))).alias("thought"), args.alias("args"), "text", F.coalesce("text", F.lit("")).alias("observation"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern a conversation: each third has no claim that can be computed again."""
    claim = F.struct(F.lit("Work function").alias("observable"), F.lit(None).cast("string").alias("recompute_handle"), F.when(F.col("paper_id") % 2 == 0, "yes").otherwise("no").alias("computable"))
    legacy = F.struct(F.lit("").alias("observable"), F.lit(" band_gap ").alias("recompute_handle"), F.lit("Y").alias("computable"))
    none = F.struct(F.lit("none").alias("observable"), F.lit(None).cast("string").alias("recompute_handle"), F.lit("yes").alias("computable"))
    heads = _turns(spark, sf_dir).groupBy(F.col("conv_id").alias("paper_id")).agg(F.max("turn").alias("last"))
    text = F.col("paper_id").cast("string")
    return heads.select("paper_id", F.concat(F.lit(" p"), text).alias("premise_consensus"), F.when(F.col("last") % 2 == 0, F.concat(F.lit("t"), text)).alias("tension"), F.concat(F.lit("m"), text, F.lit(" ")).alias("motivation"), F.when(F.col("paper_id") % 4 != 0, F.concat(F.lit("c"), text)).alias("conclusion"), F.lit("n").alias("novelty_move"), F.concat(F.lit("T"), text).alias("title"), F.when(F.col("paper_id") % 3 == 0, F.array(none)).otherwise(F.array(claim, none, legacy)).alias("key_claims"))


_PATTERNS = """patterns AS (SELECT conv_id AS paper_id, max(turn) AS last, CASE WHEN conv_id % 3 = 0 THEN [] WHEN conv_id % 2 = 0 THEN ['Work function', 'band_gap'] ELSE ['band_gap', 'Work function'] END AS handles,
      CASE WHEN conv_id % 4 <> 0 THEN 'c' || conv_id END AS conclusion FROM conversations GROUP BY 1)"""


@query("L9_trajectories", f"""WITH {_RECORDS}, {_PATTERNS}, placed AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY paper_id) AS n, count(*) FILTER (move = 'other:look') OVER (PARTITION BY paper_id) AS escapes FROM records)
    SELECT 'discovery::' || p.paper_id AS id, 'Given the prior understanding that p' || p.paper_id || ' resolve the following open question: ' || CASE WHEN last % 2 = 0 THEN 't' ELSE 'm' END || p.paper_id AS goal,
      CASE WHEN len(handles) > 0 THEN 'recompute anchors: ' || array_to_string(handles, ', ') END AS task_spec, place AS idx, split_part(move, ':', 1) AS action, computes IS NOT NULL AS has_args, nullif(thought, '') AS thought,
      CASE WHEN place = n - 1 AND move = 'draw_conclusion' THEN 'res=' || coalesce(conclusion, observation) WHEN move = 'run_calculation:dft' THEN 'computes=' || coalesce(computes, 'none') || ';exec_tool=' ELSE '' END AS content,
      CASE WHEN place = n - 1 THEN CASE WHEN len(handles) > 0 THEN 'rule' ELSE 'model' END END AS style, CASE WHEN place = n - 1 AND len(handles) = 0 THEN conclusion END AS claim, escapes, true AS read_back
    FROM placed JOIN patterns p USING (paper_id)""", longs=("idx", "escapes"))
def l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories built from all turns; each step beside what the inverse reads back for it."""
    given = records(spark, sf_dir)
    built = E.build_trajectories(patterns(spark, sf_dir), given)
    steps_ = built.select("paper_id", "id", "goal", "task_spec", F.size("metadata.escape_hatch_moves").alias("escapes"), F.explode("steps").alias("s"))
    content = F.array_join(F.transform(F.map_entries("s.observation.content"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    laid = steps_.select("paper_id", "id", "goal", "task_spec", F.col("s.index").alias("idx"), F.col("s.action.name").alias("action"), (F.size(F.map_keys("s.action.params")) > 0).alias("has_args"), F.col("s.thought").alias("thought"), content.alias("content"), F.col("s.reward.style").alias("style"), F.col("s.reward.qualitative_claim").alias("claim"), "escapes")
    order = Window.partitionBy("paper_id").orderBy("idx")
    wanted = given.select("paper_id", (F.row_number().over(order) - 1).alias("idx"), F.struct("move", F.nullif("thought", F.lit("")).alias("thought"), F.to_json("args").alias("args"), "observation").alias("w"))
    read = E.trajectory_records(built).select("paper_id", "idx", F.struct("move", "thought", F.when(F.size(F.map_keys("args")) > 0, F.to_json("args")).alias("args"), "observation").alias("r"))
    same = wanted.join(read, ["paper_id", "idx"]).select("paper_id", "idx", F.col("w").eqNullSafe(F.col("r")).alias("read_back"))
    return laid.join(same, ["paper_id", "idx"], "left").drop("paper_id")
