"""Text templates with named fields, compiled to column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compiled(template: str, fields: dict[str, Column]) -> Column:
    """UD9: a template with ``{name}`` fields and ``{{ }}`` for braces, as one concatenation.

    Values go in as they are, braces and all; a null one is empty.  A field that isn't
    given, a nameless one, or one with a format or an attribute is an error, and so is a
    field that is given and not used.
    """
    parts, used = [], set()
    for text, name, form, conversion in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if name not in fields or form or conversion:
            raise ValueError(f"no field {name!r} of that form; there are {', '.join(sorted(fields))}")
        used.add(name)
        parts.append(F.coalesce(fields[name], F.lit("")))
    if unused := set(fields) - used:
        raise ValueError(f"the template doesn't use {', '.join(sorted(unused))}")
    return F.concat(*parts) if parts else F.lit("")


def rendered(rows: DataFrame, versions: dict[str, str], fields: dict[str, Column], key: str) -> DataFrame:
    """UD9: (key, version, text): each row in each version of a template, in one pass over the rows."""
    texts = [F.struct(F.lit(v).alias("version"), compiled(t, fields).alias("text")) for v, t in versions.items()]
    return rows.select(key, F.explode(F.array(*texts)).alias("r")).select(key, "r.*")
