"""Correctness gates as a registry: a task's handle picks its gate, every gate gives the same verdict.

A rollout's own numbers are taken only where no re-execution of its spec is known.  Those
are rows of a table by the spec's hash, so what has been computed once serves all rollouts
that chose it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from tessera.functions.python_json import python_json
from tessera.functions.scalars import strip
from tessera.operators import scoring as R
from tessera.operators.predicates import known_fields

# The fields of specs, and what a task without a system is re-executed on.
STRUCTURE_FIELDS = ("kind", "element", "facet", "supercell", "layers", "vacuum", "adsorbate", "site", "height", "formula", "box", "a", "support", "active_metal", "defect", "miller")
METHOD_FIELDS = ("code", "functional", "ecutwfc", "ecutrho", "kpts", "smearing", "degauss", "hubbard_u", "calc")
DEFAULT_STRUCTURE = {"kind": "slab", "facet": "111", "supercell": "2,2", "layers": "3", "adsorbate": "CO"}


@dataclass(frozen=True)
class Gate:
    """A gate's name, the handles that pick it, its verdict over a row's columns, and whether only a valid, matched result is correct."""

    name: str
    handles: tuple[str, ...]
    build: Callable[[], Column]
    strict: bool = False


_KNOWN: dict[str, Gate] = {}


def register(gate: Gate) -> Gate:
    """UD6: make a gate known; a handle has one gate."""
    taken = {h: g.name for g in _KNOWN.values() if g.name != gate.name for h in g.handles}
    if twice := [h for h in gate.handles if h in taken]:
        raise ValueError(f"{twice[0]} has the gate {taken[twice[0]]}")
    _KNOWN[gate.name] = gate
    return gate


def _measured(field: str) -> Column:
    """A re-executed value before a reported one."""
    return F.coalesce(F.col(f"again.{field}"), F.col(f"reported.{field}"))


_tier = lambda: F.coalesce("again.tier", F.lit("reported"))
register(Gate("adsorption", R.ADSORPTION, lambda: R.adsorption_verdict(_measured("e_ads"), F.when(F.col("again.e_ads").isNotNull(), F.col("again.site")).otherwise(F.col("reported.site")), F.col("gold.site_preference"), F.col("gold.energy_eV"), _tier())))
register(Gate("barrier", ("reaction_barrier",), lambda: R.window_verdict(_measured("barrier"), F.col("gold.barrier_eV"), _tier(), 0.0, 6.0, 0.3)))
register(Gate("vibration", ("vibrational_frequency",), lambda: R.window_verdict(_measured("frequency"), F.col("gold.frequency_cm1"), _tier(), 200.0, 4000.0, 80.0)))
register(Gate("metric", (), lambda: R.metric_verdict(F.col("reported.metric"), F.lower(F.coalesce("reported.metric_name", "handle", F.lit(""))), F.col("reported.executed"), F.col("gold.numeric"), higher=F.col("higher_is_better")), strict=True))
register(Gate("soft", (), R.soft_verdict))


def gate_of(handle: Column, numeric_gold: Column) -> Column:
    """The gate that has the handle; else the metric's for a numeric gold, else the soft one."""
    handle = strip(F.coalesce(handle, F.lit("")))
    named = [F.when(handle.isin(*g.handles), g.name) for g in _KNOWN.values() if g.handles]
    return F.coalesce(*named, F.when(numeric_gold.isNotNull(), "metric"), F.lit("soft"))


def respec(system: Column, method: Column, metal: Column) -> Column:
    """struct(structure, method, hash) of what is to be re-executed: the task's pinned fields that specs have, else a clean slab of its metal.

    Fields are texts; the hash is that of both maps as sorted JSON.
    """
    some = lambda m: F.coalesce(F.size(m) > 0, F.lit(False))
    default = F.map_concat(F.create_map(*[F.lit(x) for kv in DEFAULT_STRUCTURE.items() for x in kv]), F.create_map(F.lit("element"), F.coalesce(metal, F.lit("Pt"))))
    structure = F.when(some(system), known_fields(system, F.array(*map(F.lit, STRUCTURE_FIELDS)))).otherwise(default)
    plan = F.when(some(method), known_fields(method, F.array(*map(F.lit, METHOD_FIELDS)))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kind = MapType(StringType(), StringType())
    return F.struct(structure.alias("structure"), plan.alias("method"), F.sha2(F.concat(python_json(structure, kind, sort_keys=True), python_json(plan, kind, sort_keys=True)), 256).alias("hash"))


def verdicts(rollouts: DataFrame, executed: DataFrame | None = None) -> DataFrame:
    """R2, R4, R5, R6, R10, UD6: each rollout with ``gate``, ``mode`` and ``verdict``.

    Rollouts have handle, reported (the struct of ``parse_final``), gold (site_preference,
    energy_eV, barrier_eV, frequency_cm1, numeric), higher_is_better, system_spec and
    method_spec (maps) and metal.  ``executed`` has hash, e_ads, site, barrier, frequency
    and tier; a result of tier qe is valid.  It is joined by the spec's hash.
    """
    spec = respec(F.col("system_spec"), F.col("method_spec"), F.col("metal"))
    rows = rollouts.withColumn("_hash", spec["hash"])
    if executed is None:
        rows = rows.withColumn("again", F.lit(None).cast("struct<e_ads:map<string,double>,site:string,barrier:double,frequency:double,tier:string>"))
    else:
        known = executed.select(F.col("hash").alias("_hash"), F.struct("e_ads", "site", "barrier", "frequency", "tier").alias("again"))
        rows = rows.join(known, "_hash", "left")
    gate = gate_of(F.col("handle"), F.col("gold.numeric"))
    rows = rows.withColumn("gate", gate)
    shape = ("sane", "decisive", "valid", "matched", "graded", "trusted", "g")
    no = F.lit(False)

    def judged(g: Gate) -> Column:
        v = g.build()
        sound = F.coalesce(v["sane"] & v["decisive"], no)
        correct = sound & F.coalesce(v["valid"] & v["matched"], no) if g.strict else sound & F.coalesce(v["matched"], F.lit(True))
        return F.struct((F.lit(False) if g.name == "soft" else correct).alias("correct"), *(v[f].alias(f) for f in shape))

    chosen = F.coalesce(*(F.when(F.col("gate") == g.name, judged(g)) for g in _KNOWN.values()))
    again = {"adsorption": "e_ads", "barrier": "barrier", "vibration": "frequency"}
    redone = F.coalesce(*(F.when(F.col("gate") == k, F.col(f"again.{f}").isNotNull()) for k, f in again.items()), no)
    mode = F.when(F.col("gate") == "soft", "soft-only").when(F.col("gate") == "metric", "metric-repro").when(redone, "reexecute").otherwise("trust-reported")
    return rows.withColumns({"mode": mode, "verdict": chosen}).select(*rollouts.columns, "gate", "mode", "verdict")
