import random

import pytest

from tessera.operators import episodes as E
from tessera.operators import scan, trees
from pyspark.sql import functions as F


def walked(moves):
    """The machine as a loop: (phase, accepted) of each move."""
    phase, out = 0, []
    for m in moves:
        before = phase
        if m == "reset":
            phase = 0
        elif phase < len(E.PLAN) and (m is None or m == E.PLAN[phase]):
            phase += 1
        out.append((before, m == "reset" or phase != before))
    return out


@pytest.mark.parametrize("partitions", [1, 13])
def test_episodes_like_a_loop(spark, partitions):
    rng = random.Random(partitions)
    logs = {e: [rng.choice([None, "reset" if rng.random() < 0.1 else None, *E.PLAN]) for _ in range(n)] for e, n in {1: 900, 2: 1, 3: 40, 4: 8, None: 30}.items()}
    logs[5] = list(E.PLAN) + ["draw_conclusion", "reset", None]
    rows = [(e, i, m, i % 2 == 0) for e, ms in logs.items() for i, m in enumerate(ms)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = E.replay_episodes(spark.createDataFrame(rows, "episode int, idx int, move string, rewarded boolean")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    by = {(r.episode, r.idx): r for r in got}
    for e, ms in logs.items():
        for i, (phase, accepted) in enumerate(walked(ms)):
            assert (by[e, i].phase, by[e, i].accepted) == (phase, accepted)
    end = by[5, 7]
    assert end.done and end.reward == 0.0 and end.next_move is None
    assert by[5, 8].reason == E.ENDED and not by[5, 8].done and by[5, 8].expected is None
    assert by[5, 9].accepted and by[5, 9].next_move == "survey_consensus" and by[5, 10].expected == "survey_consensus"


def test_refusals_and_rewards(spark):
    steps = [("a", i, m, True) for i, m in enumerate(E.PLAN)] + [("b", 0, "design", None)]
    got = {(r.episode, r.idx): r for r in E.replay_episodes(spark.createDataFrame(steps, "episode string, idx int, move string, rewarded boolean")).collect()}
    assert [got["a", i].reward for i in range(8)] == [0.0] * 7 + [1.0] and got["a", 7].done
    assert got["b", 0].reason == "expected move 'survey_consensus', got 'design'" and got["b", 0].next_move == "survey_consensus"
    assert E.replay_episodes(spark.createDataFrame([], "episode string, idx int, move string, rewarded boolean")).collect() == []


def test_scan_of_any_machine(spark):
    """Parity of ones so far, over one group in many partitions."""
    rows = spark.range(5000).select(F.lit("g").alias("g"), "id", (F.col("id") * 7 % 3 == 0).alias("one")).repartition(20)
    found = scan.states_before(rows, ["g"], ["id"], F.when(F.col("one"), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))), 2).collect()
    state = 0
    for r in sorted(found, key=lambda r: r.id):
        assert r.state == state
        state ^= r.one


def test_episodes_of_a_stream(spark, tmp_path):
    """Two batches of one episode: the second begins where the first has left it."""
    schema = "episode string, idx int, move string, rewarded boolean"

    def add(k, moves, at):
        spark.createDataFrame([("a", at + i, m, True) for i, m in enumerate(moves)], schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")

    def follow():
        answers = E.follow_episodes(spark.readStream.schema(schema).json(f"{tmp_path}/in/*"))
        query = answers.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    add("1", ["survey_consensus", "design", None], 0)
    follow()
    add("2", [*E.PLAN[2:], "design"], 3)
    follow()
    got = sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r.idx)
    assert [(r.phase, r.accepted) for r in got] == walked(["survey_consensus", "design", None, *E.PLAN[2:], "design"])
    assert [r.reward for r in got] == [0.0] * 8 + [1.0, 0.0] and got[-1].reason == E.ENDED


def test_trajectories_and_their_inverse(spark):
    records = [(1, 5, "other:peek", "", None, "saw"), (1, 2, "survey_consensus", "th", {"consensus": "c"}, None), (1, 9, "draw_conclusion:x", "so", {}, "end"), (2, 0, "run_calculation", None, {"tool": "run_dft", "computes": "e"}, "o"), (3, 0, None, None, None, "")]
    claims = "array<struct<observable:string,recompute_handle:string,computable:string>>"
    patterns = [(1, " p ", "t", "m", "answer", "n", "T", [("none", "", "yes"), ("b", None, "no"), ("a", None, "Yes")]), (2, "p", " ", "m", None, "n", "T", []), (3, "p", None, None, "", "n", "T", None), (4, "p", "q", None, "c", None, None, [])]
    frame = spark.createDataFrame(patterns, f"paper_id int, premise_consensus string, tension string, motivation string, conclusion string, novelty_move string, title string, key_claims {claims}")
    given = spark.createDataFrame(records, "paper_id int, idx int, move string, thought string, args map<string,string>, observation string")
    built = E.build_trajectories(frame, given)
    t = {r.paper_id: r for r in built.collect()}
    assert t[1].goal == "Given the prior understanding that p resolve the following open question: t" and t[1].task_spec == "recompute anchors: a, b"
    assert [(s["index"], s.thought, s.action.name, s.observation.content) for s in t[1].steps] == [(0, "th", "survey_consensus", {}), (1, None, "other", {}), (2, "so", "draw_conclusion", {"res": "answer"})]
    assert [s.reward and s.reward.style for s in t[1].steps] == [None, None, "rule"] and t[1].metadata.escape_hatch_moves == ["other:peek"]
    assert t[2].steps[0].observation.content == {"computes": "e", "exec_tool": "run_dft"} and t[2].steps[0].reward.style == "model" and t[2].task_spec is None
    assert t[2].goal.endswith("question: m") and t[3].metadata.escape_hatch_moves == [""] and t[4].steps == []
    back = sorted(map(tuple, E.trajectory_records(built).select("paper_id", "idx", "move", "thought", "args", "observation").collect()), key=str)
    assert back == sorted([(1, 0, "survey_consensus", "th", {"consensus": "c"}, ""), (1, 1, "other:peek", None, {}, "saw"), (1, 2, "draw_conclusion:x", "so", {}, "end"), (2, 0, "run_calculation", None, {"tool": "run_dft", "computes": "e"}, "o"), (3, 0, "", None, {}, "")], key=str)
    verdicts = spark.createDataFrame([(1, True, True, True, "good", "bad"), (2, True, None, False, "good", "bad")], "paper_id int, sane boolean, decisive boolean, valid boolean, notes_valid string, notes_invalid string")
    w = {r.paper_id: r for r in E.wire_verdict(built, verdicts).collect()}
    assert (w[1].reward, w[1].verification.judge_votes, w[1].verification.notes) == (1.0, [True, True], "good")
    assert (w[2].reward, w[2].verification.judge_votes, w[2].verification.notes) == (0.0, [], "bad") and w[3].reward is None and w[3].verification is None


def brute_tree(parents):
    out = {}
    for n in parents:
        way, seen = [n], {n}
        while parents.get(way[0]) is not None and parents[way[0]] not in seen:
            way.insert(0, parents[way[0]])
            seen.add(way[0])
        cyclic = parents.get(way[0]) is not None
        out[n] = (None, None, None, True) if cyclic else (way[0], len(way) - 1, way, False)
    return out


def test_forest(spark):
    rng = random.Random(5)
    parents = {i: rng.choice([None, rng.randrange(i), rng.randrange(300)]) if i else None for i in range(150)}
    parents |= {1000 + i: 1000 + i - 1 for i in range(1, 70)} | {1000: None}  # a long path
    parents |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2003, 2004: 2002, 2005: 2004}  # cycles and what hangs on them
    parents |= {3000 + i: 0 for i in range(60)}  # a hub
    rows = [*parents.items(), (1001, None), (None, 5), (1002, 9999999)]  # repeated and null nodes
    got = trees.hierarchy(spark.createDataFrame(rows, "node bigint, parent int")).collect()
    want = brute_tree(parents)
    assert len(got) == len(parents)
    assert {r.node: (r.root, r.depth, r.path, r.cycle) for r in got} == want
    flat = trees.hierarchy(spark.createDataFrame(rows, "node bigint, parent int"), paths=False).collect()
    assert {r.node: (r.root, r.depth, r.cycle) for r in flat} == {n: (a, b, d) for n, (a, b, _, d) in want.items()}
    assert trees.hierarchy(spark.createDataFrame([], "node bigint, parent bigint")).collect() == []
