import pytest
from pyspark.sql import functions as F

from tessera.functions import methods as M
from tessera.functions import structures as B
from tessera.operators import gates as G
from tessera.operators import trajectories as T

REPORTED = "struct<e_ads:map<string,double>,site:string,barrier:double,frequency:double,metric:double,metric_name:string,executed:boolean>"
GOLD = "struct<site_preference:string,energy_eV:double,barrier_eV:double,frequency_cm1:double,numeric:double>"
ROLLOUT = f"id int, handle string, reported {REPORTED}, gold {GOLD}, higher_is_better boolean, system_spec map<string,string>, method_spec map<string,string>, metal string"


def rollout(i, handle, reported=None, gold=None, **more):
    r = {"e_ads": {}, "executed": None} | (reported or {})
    return (i, handle, [r.get(k) for k in ("e_ads", "site", "barrier", "frequency", "metric", "metric_name", "executed")], [(gold or {}).get(k) for k in ("site_preference", "energy_eV", "barrier_eV", "frequency_cm1", "numeric")], more.get("higher"), more.get("system"), more.get("method"), more.get("metal"))


def test_each_row_takes_its_own_gate(spark):
    rows = [
        rollout(1, "site_preference", {"e_ads": {"ontop": -1.5, "fcc": -1.7}, "site": "FCC"}, {"site_preference": "fcc"}),
        rollout(2, "co_adsorption_energy", {"e_ads": {"ontop": -9.0, "fcc": -1.7}}, {"energy_eV": -1.6}),
        rollout(3, "reaction_barrier", {"barrier": 0.8}, {"barrier_eV": 1.5}),
        rollout(4, "vibrational_frequency", {"frequency": 2050.0}),
        rollout(5, "test_auc", {"metric": 0.9, "executed": True}, {"numeric": 0.85}),
        rollout(6, "test_auc", {"metric": 0.9, "executed": False}, {"numeric": 0.85}),
        rollout(7, None),
        rollout(8, "rmse_of_x", {"metric": 0.9, "executed": True}, {"numeric": 0.5}, higher=True),
    ]
    got = {r.id: r for r in G.verdicts(spark.createDataFrame(rows, ROLLOUT)).collect()}
    assert [got[i].gate for i in range(1, 9)] == ["adsorption", "adsorption", "barrier", "vibration", "metric", "metric", "soft", "metric"]
    v = {i: (r.verdict.sane, r.verdict.decisive, r.verdict.valid, r.verdict.matched, r.verdict.correct) for i, r in got.items()}
    assert v[1] == (True, True, False, True, True) and v[2] == (False, True, False, False, False) and v[3] == (True, True, False, False, False)
    assert v[4] == (True, True, False, None, True) and v[5] == (True, True, True, True, True) and v[6] == (True, True, False, None, False)
    assert v[7] == (True, True, False, None, False) and v[8][3:] == (True, True) and got[8].verdict.graded == 1.0
    assert {r.mode for r in got.values()} == {"trust-reported", "metric-repro", "soft-only"}


def test_what_was_run_again_replaces_what_was_reported(spark):
    pinned = {"element": "Pd", "facet": "100", "unknown": "x"}
    rows = spark.createDataFrame([
        rollout(1, "reaction_barrier", {"barrier": 99.0}, {"barrier_eV": 0.8}, system=pinned, method={"ecutwfc": "40"}),
        rollout(2, "reaction_barrier", {"barrier": 99.0}, {"barrier_eV": 0.8}, system=pinned, method={"ecutwfc": "50"}),
        rollout(3, "site_preference", {"e_ads": {"a": 0.1, "b": 0.1}, "site": "b"}, {"site_preference": "fcc"}, metal="Cu"),
    ], ROLLOUT)
    none = F.lit(None).cast("map<string,string>")
    specs = spark.range(1).select(
        G.respec(F.create_map(F.lit("facet"), F.lit("100"), F.lit("element"), F.lit("Pd")), F.create_map(F.lit("ecutwfc"), F.lit("40"), F.lit("junk"), F.lit("1")), F.lit("ignored")).alias("a"), G.respec(none, none, F.lit("Cu")).alias("b"), G.respec(none, none, F.lit(None).cast("string")).alias("c")
    ).head()
    assert specs.b.structure["element"] == "Cu" and specs.c.structure["element"] == "Pt" and specs.a.structure == {"element": "Pd", "facet": "100"} and specs.b.method == {}
    done = [(specs.a.hash, None, None, 0.75, None, "qe"), (specs.b.hash, {"ontop": -1.2, "fcc": -1.5}, "fcc", None, None, "emt")]
    executed = spark.createDataFrame(done, "hash string, e_ads map<string,double>, site string, barrier double, frequency double, tier string")
    got = {r.id: r for r in G.verdicts(rows, executed).collect()}
    assert (got[1].mode, got[1].verdict.correct, got[1].verdict.valid) == ("reexecute", True, True)
    assert (got[2].mode, got[2].verdict.sane) == ("trust-reported", False)
    assert (got[3].mode, got[3].verdict.matched, got[3].verdict.valid) == ("reexecute", True, False)
    assert G.verdicts(rows.where("false"), executed).count() == 0


def test_a_handle_has_one_gate(spark):
    with pytest.raises(ValueError, match="reaction_barrier has the gate barrier"):
        G.register(G.Gate("other", ("reaction_barrier",), lambda: F.lit(None)))


def clamp(spark, budget=True, **spec):
    order = ("kind", "element", "facet", "support", "defect", "supercell", "layers", "adsorbate")
    row = {"kind": "slab", "element": "Pt", "facet": "111", "supercell": [2, 2], "layers": 3, "adsorbate": "CO"} | spec
    frame = spark.createDataFrame([[row.get(c) for c in order]], "kind string, element string, facet string, support string, defect string, supercell array<int>, layers int, adsorbate string")
    return B.clamped_structures(frame, 2, 4, budget=budget).head()


def test_structures_are_repaired_in_order(spark):
    assert clamp(spark).notes == []
    r = clamp(spark, element="Xx", facet="0001", supercell=[3, 1], layers=1)
    assert (r.element, r.facet, r.supercell, r.layers) == ("Pt", "111", [2, 1], 2)
    assert r.notes == ["metal 'Xx' has no wired crystal → Pt(111)", "facet '0001'→111 (not wired for fcc)", "supercell capped to (2, 1) for real-DFT budget", "layers 1→2 (1-layer slab freezes all atoms, no forces)"]
    assert clamp(spark, element="Co", facet=None).notes == ["facet None→0001 (not wired for hcp)"]
    r = clamp(spark, kind="supported", facet="edge", support="Anatase TiO2", supercell=[2, 2])
    assert (r.support, r.supercell, r.facet) == ("tio2_anatase", [1, 1], "edge")  # the support is repaired before its cells
    assert r.notes == ["support 'anatase tio2'→tio2_anatase (wired oxide preset)", "oxide supercell→(1,1) for real-DFT budget"]
    r = clamp(spark, kind="supported", support=None, defect=None, supercell=[4, 2])
    assert (r.support, r.defect, r.supercell) == ("graphene", "vacancy", [3, 2])
    assert r.notes == ["support 'none'→graphene (only wired carbon support)", "defect None→vacancy", "supercell capped to (3, 2)"]
    assert clamp(spark, kind="supported", support="Al2O3", supercell=[1, 1]).notes == ["oxide support 'al2o3'→ceo2 (nearest wired preset)"]
    assert clamp(spark, budget=False, layers=1, supercell=[9, 9]).notes == []
    assert [clamp(spark, adsorbate=a).adsorbate for a in ("CO", " CH3OH ", "CO*", "Qq", "", None, "Fe(CO)5", "co")] == ["CO", "CH3OH", "CO", "CO", "CO", "CO", "Fe(CO)5", "CO"]


def test_notes_of_method_clamps(spark):
    rows = spark.createDataFrame([(20.0, 400.0, "mv", 0.1, [0, 4]), (400.0, 100.0, "mv", 0.001, None), (40.0, 320.0, "none", 0.9, [3]), (40.5, 320.0, "", 0.9, [17])], "w double, r double, s string, d double, k array<int>")
    got = [r.m for r in rows.select(M.clamped_method(F.col("w"), F.col("r"), F.col("s"), F.col("d"), F.col("k")).alias("m")).collect()]
    assert got[0].notes == ["ecutwfc 20.0->30", "ecutrho 400.0->360.0", "degauss 0.1->0.02", "kpts (0, 4)->(1, 4)"]
    assert got[1].notes == ["ecutwfc 400.0->90 (was unphysically high)", "ecutrho 100.0->720.0", "degauss 0.001->0.01", "kpts ()->(4, 4, 1)"] and got[1].kpts == [4, 4, 1]
    assert got[2].notes == [] and got[2].degauss == 0.9
    assert got[3].notes == ["ecutrho 320.0->324.0", "kpts (17,)->(16,)"]


def test_thoughts_name_what_was_seen(spark):
    def chain(i, *steps):
        return [(i, k, *s) for k, s in enumerate(steps)]

    good = [("try lower mixing", "charge sloshing in the log", 400), ("the charge sloshing calls for damping", "ok", 0)]
    rows = chain(1, *good) + chain(2, ("it oscillates", "nothing", 400), ("on", "ok", 0)) + chain(3, ("restart it", "x", 400), ("on", "y", 0)) + chain(4, ("converged", "x", 400), ("on", "y", 0)) + chain(5, ("", "x", 400), ("on", "y", 0)) + chain(6, ("a", "x", 0), ("b", "y", 0)) + chain(7, ("a", None, 400), ("restart now", None, 0))
    got = {r.trajectory_id: r.ok for r in T.thought_lint(spark.createDataFrame(rows, "trajectory_id int, index int, thought string, text string, exit_status int")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}


def test_notes_of_clamps_are_compiled(spark):
    """A filter's function would have every note of every row worked out without compiled code."""
    rows = spark.range(3).selectExpr("id * 60.0D as w", "400.0D as r", "'mv' as s", "0.1D as d", "array(cast(id * 10 as int)) as k")
    notes = rows.select(M.clamped_method(F.col("w"), F.col("r"), F.col("s"), F.col("d"), F.col("k"))["notes"].alias("n"))
    assert "filter(array" not in notes._jdf.queryExecution().optimizedPlan().toString()
    assert [len(r.n) for r in notes.collect()] == [4, 2, 4]


def test_turns_of_chats_are_sorted_by_compiled_code(spark):
    """array_sort calls a function for each comparison."""
    steps = spark.createDataFrame([(1, i, 0, "finished", "n", None, {"b": "2", "a": "1"}, f"s{i}", None) for i in (10, 2, 1)], "trajectory_id int, index int, exit_status int, state string, name string, thought string, params map<string,string>, text string, exit_message string")
    chat = T.chat_messages(spark.createDataFrame([(1, "sys", "goal")], "trajectory_id int, system_prompt string, goal string"), steps)
    assert "array_sort" not in chat._jdf.queryExecution().optimizedPlan().toString()
    said = [m.content for m in chat.first().messages]
    assert said[3:8:2] == ["s1", "s2", "s10"] and said[2] == 'Action: n({"a": "1", "b": "2"})'
