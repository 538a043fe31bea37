"""Scalar functions as column expressions; all of them stay in the JVM.

Comparisons with null are guarded where null means "no", and kept null where null
means "can't tell".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+\.?\d*"


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether any part occurs in the text."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


# -- numbers and units (F4, F5, F7) -----------------------------------------

# Energy units in eV, and spellings of units.
EV = {"eV": 1.0, "meV": 1e-3, "kJ/mol": 1.0 / 96.485, "kcal/mol": 1.0 / 23.061, "Ha": 27.2114, "Ry": 13.6057}
UNITS = {"ev": "eV", "mev": "meV", "kj/mol": "kJ/mol", "kjmol": "kJ/mol", "kcal/mol": "kcal/mol", "kcalmol": "kcal/mol", "ha": "Ha", "ry": "Ry", "å": "Å", "cm-1": "cm-1", "cm1": "cm-1", "k": "K"}
QUANTITY = r"(?iu)(-?\d+\.?\d*)\s*(?:\(\d+\))?\s*(eV|meV|kJ\s*/?\s*mol|kcal\s*/?\s*mol|Ha|Ry|Å|cm-?1|K)\b"


def lookup(table: dict, key: Column) -> Column:
    """The value of a literal table at a key, null if absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def plain_minus(value: Column) -> Column:
    """Unicode minus signs, dashes and superscript minus one as ASCII."""
    value = F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("−"), F.lit("-")), F.lit("–"), F.lit("-"))
    return F.replace(F.replace(value, F.lit("⁻¹"), F.lit("-1")), F.lit("⁻"), F.lit("-"))


def parse_value(value: Column) -> Column:
    """struct(raw, numeric, unit, eV); a number without a unit has numeric alone."""
    text = plain_minus(value)
    unit_key = F.lower(F.replace(first_group(text, QUANTITY, 2), F.lit(" ")))
    unit = F.coalesce(lookup(UNITS, unit_key), unit_key)
    with_unit = first_group(text, QUANTITY).cast("double")
    bare = first_group(text, f"({NUMBER})").cast("double")
    return F.struct(F.coalesce(value, F.lit("")).alias("raw"), F.coalesce(with_unit, bare).alias("numeric"), unit.alias("unit"), F.round(with_unit * lookup(EV, unit), 4).alias("eV"))


def join_unit(value: Column, unit: Column) -> Column:
    """the value with its unit behind it, unless it holds it already."""
    value, unit = F.coalesce(value, F.lit("")), F.coalesce(unit, F.lit(""))
    return F.when((unit != "") & ~F.contains(value, unit), strip(F.concat(value, F.lit(" "), unit))).otherwise(value)


def judge_score(reply: Column) -> Column:
    """the first number of a reply, held within 0 and 1."""
    return F.when(reply.rlike(NUMBER), F.greatest(F.lit(0.0), F.least(F.lit(1.0), first_group(reply, f"({NUMBER})").cast("double"))))


# -- metrics (F8 to F13) ----------------------------------------------------

# Parts of metric names, by direction and by range.
HIGHER = ("auc", "auroc", "auprc", "accuracy", "acc", "f1", "precision", "recall", "iou", "dice", "r2", "ap", "map", "specificity", "sensitivity", "correlation", "pearson", "spearman", "r_value", "bleu", "rouge", "psnr", "ssim", "ndcg", "mcc", "hit_rate", "hits", "score", "kendall")
LOWER = ("rmse", "mae", "mse", "rmsd", "error", "loss", "perplexity", "fid", "mape", "wer", "cer", "ece", "nll", "deviation")
UNIT_INTERVAL = ("auc", "auroc", "auprc", "accuracy", "acc", "f1", "precision", "recall", "iou", "dice", "r2", "ap", "map", "specificity", "sensitivity")
SIGNED_UNIT = ("correlation", "pearson", "spearman", "corr", "r_value")
#: Width of the decay beyond the tolerance; where surpassing begins; score of an exact match.
RAMP, SURPASS, MATCHED = 3.0, 0.1, 0.85


def graded_closeness(value: Column, gold: Column, tolerance: float) -> Column:
    """F8: 1 within the relative tolerance, falling to 0 over three more."""
    off = F.abs(value - gold) / F.greatest(F.abs(gold), F.lit(1e-9))
    return F.when(off <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (off - tolerance) / (RAMP * tolerance)))


def metric_direction(name: Column) -> Column:
    """whether higher is better, by parts of the name; null if unknown."""
    name = F.lower(F.coalesce(name, F.lit("")))
    return F.when(any_of(name, LOWER), False).when(any_of(name, HIGHER), True)


def improvement(value: Column, best: Column, higher: Column) -> Column:
    """signed relative improvement on the best known value."""
    return F.when(higher, 1.0).otherwise(-1.0) * (value - best) / F.greatest(F.abs(best), F.lit(1e-9))


def improvement_grade(g: Column, tolerance: float) -> Column:
    """1 for surpassing, 0.85 and up for matching, less below."""
    below = F.greatest(F.lit(0.0), MATCHED * (1.0 - (-g) / (RAMP * tolerance)))
    return F.when(g >= SURPASS, 1.0).when(g >= 0, MATCHED + (1 - MATCHED) * (g / SURPASS)).otherwise(below)


def same_scale(value: Column, best: Column) -> tuple[Column, Column]:
    """a fraction and a percentage on one scale."""
    return F.when((best > 1.5) & (F.abs(value) <= 1.5), value * 100.0).otherwise(value), F.when((F.abs(value) > 1.5) & (F.abs(best) <= 1.5) & ~((best > 1.5) & (F.abs(value) <= 1.5)), best * 100.0).otherwise(best)


def metric_sane(value: Column, name: Column) -> Column:
    """a finite number in the range that its metric has."""
    name = F.lower(F.coalesce(name, F.lit("")))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    bounded = F.when(any_of(name, UNIT_INTERVAL), value.between(0.0, 100.0)).when(any_of(name, SIGNED_UNIT), value.between(-1.0001, 1.0001)).otherwise(True)
    return F.coalesce(finite & bounded, F.lit(False))


def within(value: Column, low: float, high: float) -> Column:
    """strictly between; null is outside."""
    return F.coalesce((value > low) & (value < high), F.lit(False))


# -- names, paths and texts (F16, F23, F28 to F37) --------------------------


def slug(text: Column, most: int = 48) -> Column:
    """F16: lower-case letters and digits, all else one underscore, none at the ends."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(most))


def file_slug(text: Column, most: int = 120) -> Column:
    """F16: letters, digits, dot, underscore and hyphen of any script; all else an underscore."""
    return F.left(F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_"), F.lit(most))


def strip(text: Column | str) -> Column:
    """Python's strip: white space of Unicode and the separators 28 to 31 at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


#: Where Python's splitlines breaks.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def one_line(text: Column, most: int = 160) -> Column:
    """F32: cut first, then line feeds as spaces."""
    return F.replace(F.left(F.coalesce(text, F.lit("")), F.lit(most)), F.lit("\n"), F.lit(" "))


def task_family(task: Column) -> Column:
    """paper ids begin with W."""
    return F.when(F.startswith(task, F.lit("W")), "W-paper").otherwise("named-benchmark")


def model_key(directory: Column) -> Column:
    """a run directory's name before two underscores."""
    return F.substring_index(directory, "__", 1)


def latex_escape(text: Column) -> Column:
    """ampersand, underscore and percent for LaTeX; double quotes go."""
    for a, b in (("&", r"\&"), ("_", r"\_"), ('"', ""), ("%", r"\%")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def call_cost(reported: Column, prompt: Column, completion: Column) -> Column:
    """the reported cost, else two and ten millionths a token."""
    return F.coalesce(reported, F.coalesce(prompt, F.lit(0)) * 2e-6 + F.coalesce(completion, F.lit(0)) * 1e-5)


def thin_scale(value: Column, thin: Column) -> Column:
    """six tenths, truncated, for the thin profile."""
    return F.when(thin, F.floor(value * 0.6)).otherwise(value).cast("int")


def first_url(text: Column) -> Column:
    """the first http address, up to white space, a quote, backslash, bracket or angle."""
    return first_group(text, r"""(https?://[^\s"'\\)>]+)""")


def looks_like_image(url: Column) -> Column:
    """An image's extension before the question mark."""
    return F.lower(F.substring_index(url, "?", 1)).rlike(r"\.(jpe?g|png|gif|tiff?|svg|bmp)$")


def looks_like_path(path: Column) -> Column:
    """Short, plain characters, no digit, dot or hyphen first, a directory or a known extension."""
    plain = ~path.rlike(r"""[={}%()"'`$*?]""") & ~path.rlike(r"^[\d.-]")
    known = path.rlike(r"(?i)\.(py|json|jsonl|md|txt|csv|tsv|npy|npz|log|sh|ya?ml|toml|png|pdf|h5|hdf5|pkl|parquet|ipynb|c|cpp|f90|R)$")
    return F.coalesce((path != "") & (F.length(path) <= 300) & plain & (F.contains(path, F.lit("/")) | known), F.lit(False))


def duplicate_share(text: Column) -> Column:
    """Share of 60-character windows, every 30, that repeat; 0 under 600 characters."""
    def of(flat: Column) -> Column:
        # A window is two adjacent pieces of 30 characters: cutting once is linear, substrings by position aren't.
        pieces = F.regexp_extract_all(flat, F.lit("(?s).{30}"), F.lit(0))
        windows = F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(1), F.ceil((F.length(flat) - 60) / 30).cast("int")), lambda k: F.concat(F.element_at(p, k), F.element_at(p, k + 1))))[0]
        repeated = F.transform(F.array(windows), lambda w: 1.0 - F.size(F.array_distinct(w)) / F.size(w))
        return F.when(F.length(flat) < 600, 0.0).otherwise(repeated[0])

    # A lambda's argument is computed once; an expression inside a lambda would be for every window.
    return F.transform(F.array(F.regexp_replace(text, r"\s+", " ")), of)[0]


def reason_category(reason: Column, prefixes: tuple[str, ...]) -> Column:
    """The first known prefix of a reason, else soft."""
    return F.coalesce(*(F.when(F.startswith(reason, F.lit(p)), p) for p in prefixes), F.lit("soft"))


def non_null(*items: Column) -> Column:
    """An array of those that aren't null, in order: how gates list their problems."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())
