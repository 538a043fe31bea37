"""Scalars about sites, calculation methods, moves and task texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.python_json import python_float
from tessera.functions.scalars import lookup, non_null, strip

# Site synonyms, the shell of each element's correction, adsorption handles in order, context keys in order.
SITES = {"atop": "ontop", "on-top": "ontop", "top": "ontop", "on top": "ontop", "hollow": "fcc", "fcc-hollow": "fcc", "fcc hollow": "fcc", "hcp-hollow": "hcp", "hcp hollow": "hcp", "3-fold": "fcc"}
SHELLS = {e: "3d" for e in ("Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn")} | {e: "4d" for e in ("Nb", "Mo", "Ru", "Rh", "Pd")} | {e: "5d" for e in ("Ta", "W")} | {e: "4f" for e in ("La", "Ce", "Pr", "Nd", "Sm", "Eu", "Gd")}
CONTEXT_KEYS = ("goal", "consensus", "tension", "question", "hypothesis", "system", "method", "observations", "comparison", "interpretation")


def site(name: Column) -> Column:
    """a site's usual name; none given is ontop."""
    plain = F.lower(strip(F.coalesce(F.when(name != "", name), F.lit("ontop"))))
    return F.coalesce(lookup(SITES, plain), plain)


def agrees(computed: Column, reference: Column, kind: Column, tolerance: float = 0.2) -> Column:
    """struct(delta, agrees): texts without case for sites and categories, else numbers within the tolerance."""
    text = kind.isin("site", "categorical", "ordinal")
    delta = computed.try_cast("double") - reference.try_cast("double")
    same = F.lower(strip(computed)) == F.lower(strip(reference))
    return F.struct(F.when(~text, F.round(delta, 4)).alias("delta"), F.when(text, same).otherwise(F.abs(delta) <= tolerance).alias("agrees"))


def clamped_method(wfc: Column, rho: Column, smearing: Column, degauss: Column, kpts: Column) -> Column:
    """a method held to affordable ranges, with a note for each change in order; the density cutoff follows the clamped one.

    No points count as (4, 4, 1).
    """
    w = F.when(wfc < 30, 30.0).when(wfc > 90, 90.0).otherwise(wfc)
    r = F.greatest(F.least(rho, 12 * w), 8 * w)
    smeared = (F.coalesce(smearing, F.lit("")) != "") & (smearing != "none")
    d = F.when(smeared & (degauss > 0.05), 0.02).when(smeared & (degauss < 0.002), 0.01).otherwise(degauss)
    k = F.transform(F.coalesce(F.when(F.size(kpts) > 0, kpts), F.array(F.lit(4), F.lit(4), F.lit(1))), lambda x: F.greatest(F.lit(1), F.least(F.lit(16), x)))
    given = F.coalesce(kpts, F.array().cast("array<int>"))
    number = lambda c: python_float(c.cast("double"))
    inner = lambda c: F.array_join(c.cast("array<string>"), ", ")
    several = lambda c: F.concat(F.lit("("), inner(c), F.when(F.size(c) == 1, ",").otherwise(""), F.lit(")"))
    tell = lambda name, was, to: F.concat(F.lit(f"{name} "), was, F.lit("->"), F.lit(to) if isinstance(to, str) else to)
    # Flattened, not filtered: a filter's function would have all notes worked out without compiled code.
    noted = lambda c, n: F.when(c, F.array(n)).otherwise(F.array().cast("array<string>"))
    notes = F.flatten(F.array(
        noted((wfc < 30) | (wfc > 90), tell("ecutwfc", number(wfc), F.when(wfc < 30, "30").otherwise("90 (was unphysically high)"))),
        noted(r != rho, tell("ecutrho", number(rho), number(r))),
        noted(smeared & ((degauss > 0.05) | (degauss < 0.002)), tell("degauss", number(degauss), F.when(degauss > 0.05, "0.02").otherwise("0.01"))),
        noted(k != given, tell("kpts", several(given), several(k))),
    ))
    return F.struct(w.alias("ecutwfc"), r.alias("ecutrho"), d.alias("degauss"), k.alias("kpts"), notes.alias("notes"))


def hubbard_cards(u: Column) -> Column:
    """struct(cards, error): the card's lines for a map of element to eV; an unknown shell is an error and no cards."""
    entries = F.map_entries(u)
    unknown = F.filter(F.map_keys(u), lambda e: lookup(SHELLS, e).isNull())
    lines = F.transform(entries, lambda e: F.concat(F.lit("U "), e["key"], F.lit("-"), lookup(SHELLS, e["key"]), F.lit(" "), e["value"].cast("double").cast("string")))
    cards = F.when(F.size(u) == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("HUBBARD (ortho-atomic)")), lines))
    bad = F.size(unknown) > 0
    return F.struct(F.when(~bad, cards).alias("cards"), F.when(bad, F.concat(F.lit("no Hubbard manifold known for "), F.array_join(unknown, ", "))).alias("error"))


def without_move_label(text: Column, move: Column) -> Column:
    """a leading echo of the move's name goes, once, with the marks around it."""
    label = F.replace(move, F.lit("_"), F.lit(r"[_\s]"))
    pattern = F.concat(F.lit(r"(?i)^\s*\**\s*"), label, F.lit(r"\s*\**\s*[:\-–]?\s*"))
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, F.lit("")))


def context_view(context: Column) -> Column:
    """known keys of a context map in their order, one a line."""
    lines = non_null(*[F.when(F.coalesce(F.try_element_at(context, F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"- {k}: "), F.try_element_at(context, F.lit(k)))) for k in CONTEXT_KEYS])
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("(no prior context)")


def observables(claims: Column) -> Column:
    """handles of claims, those that can be computed first, in order; claims have observable, recompute_handle, computable."""
    handle = lambda c: strip(F.coalesce(F.when(c["observable"] != "", c["observable"]), c["recompute_handle"], F.lit("")))
    named = F.filter(claims, lambda c: (handle(c) != "") & (F.lower(handle(c)) != "none"))
    can = lambda c: F.startswith(F.lower(F.coalesce(c["computable"], F.lit(""))), F.lit("y"))
    return F.concat(F.transform(F.filter(named, can), handle), F.transform(F.filter(named, lambda c: ~can(c)), handle))


def picked_handle(handles: Column) -> Column:
    """the first adsorption handle that is there; site_preference for none at all; null for others alone."""
    found = F.coalesce(*(F.when(F.array_contains(handles, F.lit(h)), h) for h in ("co_adsorption_energy", "site_preference", "coverage_shift")))
    return F.coalesce(found, F.when(F.size(handles) == 0, "site_preference"))


def task_query(premise: Column, tension: Column, hide_tension: bool = False) -> Column:
    """What an agent is asked; the tension may be left for it to find."""
    said, crack = strip(F.coalesce(premise, F.lit(""))), strip(F.coalesce(tension, F.lit("")))
    if hide_tension:
        return F.concat(F.lit("Given the established understanding that "), said, F.lit(" — identify an open question or tension in this consensus that a calculation could resolve, then resolve it."))
    return F.concat(F.lit("Given that "), said, F.lit(" resolve: "), crack)


def scf_iterations(value: Column) -> Column:
    """a VARIANT count, or the last of a list of counts."""
    last = F.element_at(F.call_function("try_variant_get", value, F.lit("$"), F.lit("array<int>")), -1)
    return F.coalesce(F.call_function("try_variant_get", value, F.lit("$"), F.lit("int")), last)
