"""Scoring: correctness gates and the reward, as column expressions over one row a rollout.

A verdict's matched gold is true, false or null for "nothing to compare"; null sends
a row to the soft reward and never to zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as C

#: Names of gates by handle.
ADSORPTION = ("site_preference", "co_adsorption_energy", "coverage_shift")


def parse_final(answer: Column) -> Column:
    """the fields of a final block; absent fields are null."""
    answer = F.coalesce(answer, F.lit(""))
    field = lambda p: C.strip(C.first_group(answer, f"(?id){p}"))
    number = lambda p: C.first_group(answer, rf"(?i){p}\s*:\s*({C.NUMBER})").cast("double")
    inner = F.coalesce(C.first_group(answer, r"(?i)E_ads_eV\s*:\s*\{([^}]*)\}"), F.lit(""))
    pair = rf"([A-Za-z_\-]+)\s*:\s*({C.NUMBER})"
    names = F.transform(F.regexp_extract_all(inner, F.lit(pair), 1), F.lower)
    values = F.transform(F.regexp_extract_all(inner, F.lit(pair), 2), lambda x: x.cast("double"))
    entries = F.arrays_zip(names.alias("k"), values.alias("v"))
    # The last value of a repeated name wins and keeps the first one's place.
    kept = F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("k"), F.element_at(F.filter(entries, lambda e: e["k"] == n), -1)["v"].alias("v")))
    return F.struct(
        F.map_from_entries(kept).alias("e_ads"),
        F.lower(field(r"site_preference\s*:\s*([A-Za-z_\-]+)")).alias("site"),
        number("barrier_eV").alias("barrier"),
        number("frequency_cm1").alias("frequency"),
        number("metric_value").alias("metric"),
        F.lower(field(r"metric_name\s*:\s*([A-Za-z0-9_\-/ ]+)")).alias("metric_name"),
        answer.rlike(r"(?i)executed\s*:\s*(true|1|yes)\b").alias("executed"),
        *(F.coalesce(field(rf"{n}\s*:\s*(.+)"), F.lit("")).alias(n) for n in ("conclusion", "system", "method")),
    )


def gate_kind(handle: Column, numeric_gold: Column) -> Column:
    """Which gate a task takes: by its handle, else by a numeric gold, else none."""
    handle = C.strip(F.coalesce(handle, F.lit("")))
    return F.when(handle.isin(*ADSORPTION), "adsorption").when(handle == "reaction_barrier", "barrier").when(handle == "vibrational_frequency", "vibration").when(numeric_gold.isNotNull(), "metric").otherwise("soft")


def match_gold(energies: Column, site: Column, gold_site: Column, gold_energy: Column, tolerance: float = 0.2) -> Column:
    """Sites if both are given, else the least energy within the tolerance, else null."""
    least = F.array_min(F.map_values(energies))
    return F.when((F.coalesce(gold_site, F.lit("")) != "") & (F.coalesce(site, F.lit("")) != ""), F.lower(site) == F.lower(gold_site)).when(gold_energy.isNotNull() & (F.size(energies) > 0), F.abs(least - gold_energy) <= tolerance)


def _verdict(sane: Column, decisive: Column, valid: Column, matched: Column, graded: Column | None = None, trusted: Column | None = None) -> Column:
    graded = F.lit(None).cast("double") if graded is None else graded
    return F.struct(sane.alias("sane"), decisive.alias("decisive"), valid.alias("valid"), matched.cast("boolean").alias("matched"), graded.alias("graded"), (F.lit(False) if trusted is None else trusted).alias("trusted"), F.lit(None).cast("double").alias("g"))


def adsorption_verdict(energies: Column, site: Column, gold_site: Column, gold_energy: Column, tier: Column, tolerance: float = 0.2) -> Column:
    """R2 on reported energies: all in the window, and two that differ."""
    values = F.map_values(energies)
    some = F.size(energies) > 0
    sane = F.coalesce(some & F.forall(values, lambda v: (v > -4.0) & (v < 0.5)), F.lit(False))
    two = F.size(energies) >= 2
    apart = F.when(two, F.abs(F.try_element_at(values, F.lit(1)) - F.try_element_at(values, F.lit(2))) > 0.01)
    decisive = F.when(site.isNull() | two, F.coalesce(apart, F.lit(False))).otherwise(some)
    return _verdict(sane, F.coalesce(decisive, F.lit(False)), tier == "qe", match_gold(energies, site, gold_site, gold_energy, tolerance))


def window_verdict(value: Column, gold: Column, tier: Column, low: float, high: float, tolerance: float) -> Column:
    """Barriers (0 to 6 eV, tolerance 0.3) and frequencies (200 to 4000, tolerance 80)."""
    return _verdict(C.within(value, low, high), value.isNotNull(), tier == "qe", F.abs(value - gold) <= tolerance)


def metric_verdict(value: Column, name: Column, executed: Column, gold: Column, tolerance: float = 0.1, require_execution: bool = True, higher: Column | None = None) -> Column:
    """Reproduction of a reported metric; a number that no run produced isn't compared."""
    sane = C.metric_sane(value, name)
    ran = F.coalesce(executed, F.lit(False)) if require_execution else F.lit(True)
    better = C.metric_direction(name) if higher is None else F.coalesce(higher, C.metric_direction(name))
    v, best = C.same_scale(value, gold)
    g = C.improvement(v, best, better)
    near = F.abs(v - best) <= tolerance * F.greatest(F.abs(best), F.lit(1e-9))
    comparable = gold.isNotNull() & value.isNotNull() & ran
    matched = F.when(comparable, F.when(~sane, False).when(better.isNull(), near).otherwise(g >= -tolerance))
    graded = F.when(comparable, F.when(~sane, 0.0).when(better.isNull(), C.graded_closeness(v, best, tolerance)).otherwise(C.improvement_grade(g, tolerance)))
    return F.struct(sane.alias("sane"), value.isNotNull().alias("decisive"), ran.alias("valid"), matched.alias("matched"), graded.alias("graded"), ran.alias("trusted"), F.when(comparable & sane & better.isNotNull(), g).alias("g"))


def soft_verdict() -> Column:
    """Nothing to verify."""
    return _verdict(F.lit(True), F.lit(True), F.lit(False), F.lit(None).cast("boolean"))


def judged(score: Column, floor: Column | None = None) -> Column:
    """A judge's score, at least the floor; a half, or the floor, without one."""
    return F.coalesce(score, F.lit(0.5)) if floor is None else F.greatest(F.coalesce(score, F.lit(0.0)), floor)


def reward(verdict: Column, significance: Column, novelty: Column, conclusion: Column, unverified: Column, respect_unverified: bool = True) -> Column:
    """struct(reward, correctness, admissible, unverified, unrounded); ``reward`` has four digits, thresholds take ``unrounded``.

    Verified: correctness, or graded closeness where the number is trusted, times 0.4 and
    the soft band.  Unverified: soft scores alone, never admissible.
    """
    sane, decisive, matched = verdict["sane"], verdict["decisive"], verdict["matched"]
    proxy = F.coalesce(sane & decisive & matched, F.lit(False))
    loose = matched.isNull() | (F.coalesce(unverified, F.lit(False)) if respect_unverified else F.lit(False))
    soft = 0.2 * significance + 0.2 * novelty + 0.2 * conclusion
    hard = F.when(verdict["trusted"] & verdict["graded"].isNotNull(), verdict["graded"]).otherwise(proxy.cast("double"))
    value = F.when(loose, 0.5 * conclusion + 0.25 * significance + 0.25 * novelty).otherwise(hard * (0.4 + soft))
    return F.struct(F.round(value, 4).alias("reward"), proxy.cast("double").alias("correctness"), F.coalesce(~loose & proxy & verdict["valid"], F.lit(False)).alias("admissible"), loose.alias("unverified"), value.alias("unrounded"))


# What marks an energy by another method than the recomputation's.
CROSS_METHOD = r"(?i)\bDMC\b|\bQMC\b|diffusion monte|\bCCSD|coupled.?cluster|\bGW\b|\bRPA\b|\bMP2\b|experiment|measured|\bIR\b spectro|calorimet"


def claim_records(claims: DataFrame) -> DataFrame:
    """Rows (task, pos, observable, recompute_handle, claim, value, unit) with a handle, parsed."""
    handle = C.strip(F.coalesce(F.when(F.col("observable") != "", F.col("observable")), "recompute_handle", F.lit("")))
    rows = claims.withColumn("handle", handle).where("handle != '' and lower(handle) != 'none'")
    return rows.withColumn("parsed", C.parse_value(C.join_unit(F.col("value"), F.col("unit")))).select("task", "pos", "handle", "claim", "parsed.*")


def gold_for_handle(records: DataFrame) -> DataFrame:
    """Each (task, handle)'s best record: one with an energy first, then a number, then the earliest."""
    over = Window.partitionBy("task", "handle").orderBy(F.col("eV").isNull(), F.col("numeric").isNull(), "pos")
    best = records.withColumn("_place", F.row_number().over(over)).where("_place = 1").drop("_place")
    cross = F.concat_ws(" ", "claim", "raw").rlike(CROSS_METHOD)
    return best.select("task", "handle", "claim", F.col("raw").alias("value_raw"), F.when(~cross, F.col("eV")).alias("energy_eV"), F.when(cross, F.col("eV")).alias("reference_eV"), (cross & F.col("eV").isNotNull()).alias("cross_method"), "numeric", F.when(F.col("numeric").isNotNull(), F.col("unit")).alias("unit"))
