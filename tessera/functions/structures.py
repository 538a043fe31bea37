"""structure specs held to what can be built and paid for.

Rules run in order over the spec's columns, and each sees what those before it have
repaired.  Every repair leaves a note; a spec that is fine comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import lookup, non_null, strip

# Metals by crystal, facets that can be built, supports and what they are also called.
CRYSTALS = {
    "fcc": ("Pt", "Pd", "Ni", "Cu", "Au", "Ag", "Rh", "Ir", "Pb", "Al", "Ca", "Sr"),
    "bcc": ("Fe", "W", "Mo", "Cr", "V", "Nb", "Ta", "Ba"),
    "hcp": ("Co", "Ru", "Re", "Ti", "Zn", "Mg", "Zr", "Os", "Cd", "Y", "Sc"),
}
FACETS = {"fcc": ("111", "100", "110"), "bcc": ("110", "100", "111"), "hcp": ("0001",)}
OXIDES = ("ceo2", "tio2", "tio2_anatase")
OXIDE_NAMES = (("anatase", "tio2_anatase"), ("rutile", "tio2"), ("tio2", "tio2"), ("titania", "tio2"), ("ceria", "ceo2"), ("ceo2", "ceo2"), ("cerium", "ceo2"))
DEFECTS = ("vacancy", "divacancy", "pristine")
NO_FACET = ("supported", "monolayer_2d", "molecule", "bulk")
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
).split()

SPEC = ("kind", "element", "facet", "support", "defect", "supercell", "layers", "adsorbate")


def quoted(text: Column) -> Column:
    """A text as notes show it; null is None."""
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("None"))


def known_formula(text: Column) -> Column:
    """Whether a text is symbols of elements with numbers, in brackets or not."""
    symbols = F.regexp_extract_all(text, F.lit("[A-Z][a-z]?"), F.lit(0))
    return text.rlike(r"^(?:[A-Z][a-z]?\d*|\((?:[A-Z][a-z]?\d*)+\)\d*)+\z") & F.forall(symbols, lambda s: s.isin(*ELEMENTS))


def _facet(rows: DataFrame) -> DataFrame:
    """A slab of a metal whose crystal has builders, on a facet that one builds."""
    slab = ~F.coalesce(F.col("kind").isin(*NO_FACET), F.lit(False))
    metal = F.coalesce(F.when(F.col("element") != "", F.col("element")), F.lit("Pt"))
    crystal = lookup({e: c for c, es in CRYSTALS.items() for e in es}, metal)
    unknown = slab & crystal.isNull()
    rows = rows.withColumns({"_crystal": F.coalesce(crystal, F.lit("fcc")), "_n1": F.when(unknown, F.concat(F.lit("metal "), quoted(metal), F.lit(" has no wired crystal → Pt(111)"))), "element": F.when(unknown, "Pt").otherwise(F.col("element"))})
    built = F.coalesce(*(F.when(F.col("_crystal") == c, F.coalesce(F.col("facet").isin(*fs), F.lit(False))) for c, fs in FACETS.items()))
    usual = lookup({c: "111" if "111" in fs else min(fs) for c, fs in FACETS.items()}, F.col("_crystal"))
    off = slab & ~built
    note = F.when(off, F.concat(F.lit("facet "), quoted(F.col("facet")), F.lit("→"), usual, F.lit(" (not wired for "), "_crystal", F.lit(")")))
    return rows.withColumns({"_n2": note, "facet": F.when(off, usual).otherwise(F.col("facet"))}).withColumn("notes", F.concat("notes", non_null(F.col("_n1"), F.col("_n2")))).drop("_crystal", "_n1", "_n2")


def _support(rows: DataFrame) -> DataFrame:
    """An oxide with a preset, by its name or a part of it; all else is a metal atom on carbon."""
    on = F.coalesce(F.col("kind") == "supported", F.lit(False))
    name = F.lower(F.coalesce("support", F.lit("")))
    preset = F.coalesce(*(F.when(F.contains(name, F.lit(k)), v) for k, v in OXIDE_NAMES))
    oxide = F.contains(name, F.lit("oxide")) | F.endswith(name, F.lit("o2")) | F.endswith(name, F.lit("o3"))
    exact = name.isin(*OXIDES)
    to = F.when(exact, name).when(preset.isNotNull(), preset).when(oxide, "ceo2").otherwise("graphene")
    said = lambda shown, reason: F.concat(shown, F.lit("→"), to, F.lit(f" ({reason})"))
    changed = ~F.col("support").eqNullSafe(to)
    note = (
        F.when(~on | exact, None).when(preset.isNotNull(), F.when(changed, said(F.concat(F.lit("support "), quoted(name)), "wired oxide preset")))
        .when(oxide, said(F.concat(F.lit("oxide support "), quoted(name)), "nearest wired preset")).when(name != "graphene", said(F.concat(F.lit("support "), quoted(F.when(name != "", name).otherwise("none"))), "only wired carbon support"))
    )
    carbon = on & (to == "graphene")
    lost = carbon & ~F.lower(F.coalesce("defect", F.lit(""))).isin(*DEFECTS)
    second = F.when(lost, F.concat(F.lit("defect "), quoted(F.col("defect")), F.lit("→vacancy")))
    kept = F.when(on & ~(carbon & (name == "graphene")), to).otherwise(F.col("support"))
    return rows.withColumns({"notes": F.concat("notes", non_null(note, second)), "support": kept, "defect": F.when(lost, "vacancy").otherwise(F.col("defect"))})


def _budget(rows: DataFrame, most_cells: int | None, most_layers: int | None) -> DataFrame:
    """Cells and layers within the budget, for the support that the rules before have left."""
    on = F.coalesce(F.col("kind") == "supported", F.lit(False))
    oxide = on & F.coalesce(F.col("support").isin(*OXIDES), F.lit(False))
    cells = F.coalesce("supercell", F.array(F.lit(2), F.lit(2)))
    text = lambda c: F.concat(F.lit("("), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit(")"))
    held = lambda most: F.transform(cells, lambda x: F.least(x, F.lit(most)))
    one = F.array(F.lit(1), F.lit(1))
    slab_cells = held(most_cells) if most_cells else cells
    to = F.when(oxide, F.when(F.coalesce(F.col("supercell"), one) != one, one)).when(on, F.when(F.exists(F.coalesce(F.col("supercell"), one), lambda x: x > 3), held(3))).otherwise(F.when(cells != slab_cells, slab_cells))
    note = F.when(to.isNotNull(), F.when(oxide, "oxide supercell→(1,1) for real-DFT budget").when(on, F.concat(F.lit("supercell capped to "), text(to))).otherwise(F.concat(F.lit("supercell capped to "), text(to), F.lit(" for real-DFT budget"))))
    layers = F.coalesce(F.when(F.col("layers") != 0, F.col("layers")), F.lit(3))
    many = ~on & (layers > most_layers) if most_layers else F.lit(False)
    capped = F.when(many, most_layers).otherwise(layers)
    thin = ~on & (capped < 2)
    shown = F.when(many, F.lit(most_layers)).otherwise(F.col("layers")).cast("string")
    notes = non_null(note, F.when(many, f"layers capped to {most_layers}"), F.when(thin, F.concat(F.lit("layers "), shown, F.lit("→2 (1-layer slab freezes all atoms, no forces)"))))
    return rows.withColumns({"notes": F.concat("notes", notes), "supercell": F.coalesce(to, F.col("supercell")), "layers": F.when(thin, 2).when(many, most_layers).otherwise(F.col("layers"))})


def _adsorbate(rows: DataFrame) -> DataFrame:
    """A formula, else CO."""
    given = strip(F.coalesce(F.when(F.col("adsorbate") != "", F.col("adsorbate")), F.lit("CO")))
    return rows.withColumn("adsorbate", F.when(F.coalesce(known_formula(given), F.lit(False)), given).otherwise("CO"))


def clamped_structures(specs: DataFrame, most_cells: int | None = None, most_layers: int | None = None, budget: bool = False) -> DataFrame:
    """specs (columns of SPEC and others) repaired, and ``notes`` on each repair in order; with ``budget`` sizes are held down as well."""
    rows = _support(_facet(specs.withColumn("notes", F.array().cast("array<string>"))))
    return _adsorbate(_budget(rows, most_cells, most_layers) if budget else rows)
