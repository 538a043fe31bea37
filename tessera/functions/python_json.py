"""JSON as Python's ``json.dumps`` writes it, from columns of any nesting.

The expression follows the column's type, so all stays in the JVM: keys in order or
sorted, indented or on one line, floats with the fewest digits that give them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters with names of their own in JSON.
_NAMED = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _zeros(n: Column) -> Column:
    return F.repeat(F.lit("0"), n)


def _shortest(v: Column) -> Column:
    """Of a number 0.D times ten to the place: the fewest digits that give x back.

    The digits at hand give it back too, but may be a few too many.
    """
    n = F.length(v["d"])

    def rounded(p: Column) -> Column:
        up = v["d"].cast("decimal(20,0)") + F.concat(F.lit("5"), _zeros(n - p - 1)).cast("decimal(20,0)")
        return F.call_function("div", up, F.concat(F.lit("1"), _zeros(n - p)).cast("decimal(20,0)"))

    def same(p: Column) -> Column:
        return F.concat(rounded(p).cast("string"), F.lit("E"), (v["place"] - p).cast("string")).cast("double") == v["x"]

    def cut(p: Column) -> Column:
        # Rounding may carry: 9.99 to two digits is 100 tenths.
        return _once(rounded(p).cast("string"), lambda r: F.struct(F.rtrim(r, F.lit("0")).alias("d"), (v["place"] + F.length(r) - p).alias("place")))

    whole = F.struct(v["d"].alias("d"), v["place"].alias("place"))
    return F.when((n > 1) & same(n - 1), cut(F.element_at(F.filter(F.sequence(F.lit(1), n - 1), same), 1))).otherwise(whole)


def python_float(x: Column) -> Column:
    """UD5: a double as Python's repr: exponents from 1e16 on and below 1e-4; ``NaN`` and ``Infinity`` as JSON has them there; null stays null.

    It always reads back as the same double and is as short as Python's.  JVMs before 19 don't
    know the nearest 17 digits of all numbers from 2**63 on: about one in 100,000 of those
    taken at random then ends in a neighbouring digit.
    """
    # What the JVM writes in up to 15 digits without an exponent, and with no needless zero, is the shortest there is:
    # decimals of so few digits are doubles of their own.
    short = x.cast("string")
    plain = (F.length(short) <= 16) & ~F.contains(short, F.lit("E")) & (~F.endswith(short, F.lit("0")) | F.endswith(short, F.lit(".0")))
    return F.when(plain, short).otherwise(_any_float(x))


def _any_float(x: Column) -> Column:
    # The JVM rounds whole numbers of this size to digits that aren't the nearest.
    text = F.when((F.abs(x) >= 2.0**53) & (F.abs(x) < 2.0**63), F.concat(F.abs(x).try_cast("bigint").cast("string"), F.lit(".0"))).otherwise(F.abs(x).cast("string"))
    mantissa = F.substring_index(text, "E", 1)
    shift = F.coalesce(F.try_element_at(F.split(text, "E"), F.lit(2)).cast("int"), F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    every = F.concat(whole, F.substring_index(mantissa, ".", -1))
    lead = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
    given = F.struct(F.trim(every, F.lit("0")).alias("d"), (F.length(whole) + shift - lead).alias("place"), F.abs(x).alias("x"))

    def written(v: Column) -> Column:
        d, place, n = v["d"], v["place"], F.length(v["d"])
        power = place - 1
        exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
        scientific = F.concat(F.left(d, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, 20))).otherwise(""), F.lit("e"), exponent)
        small = F.concat(F.lit("0."), _zeros(-place), d)
        large = F.concat(d, _zeros(place - n), F.lit(".0"))
        middle = F.concat(F.left(d, place), F.lit("."), F.substr(d, place + 1))
        return F.when((power < -4) | (power >= 16), scientific).when(place <= 0, small).when(place >= n, large).otherwise(middle)

    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    number = F.when(x == 0, "0.0").otherwise(_once(given, lambda v: _once(_shortest(v), written)))
    special = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Infinity")))
    return F.when(x.isNotNull(), F.coalesce(special, F.concat(sign, number)))


def python_string(text: Column, ascii_only: bool = False) -> Column:
    """A string in quotes, escaped as Python does; with ``ascii_only`` other characters as ``\\uXXXX``, surrogates in pairs."""
    usual = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in (9, 10):
        usual = F.replace(usual, F.lit(chr(code)), F.lit(_NAMED[code]))
    marked = usual
    for code in (c for c in range(32) if c not in (9, 10)):
        marked = F.replace(marked, F.lit(chr(code)), F.lit(_NAMED.get(code, f"\\u{code:04x}")))
    # Few texts hold any of these, and fewer a control character that isn't a tab or a line feed.
    out = F.when(~text.rlike('["\\\\\\x00-\\x1f]'), text).when(~text.rlike("[\\x00-\\x08\\x0b-\\x1f]"), usual).otherwise(marked)
    if ascii_only:
        unit = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(c)), 4, "0"))

        def plain(c: Column) -> Column:
            code = F.ascii(c)
            pair = F.concat(unit(F.floor((code - 0x10000) / 1024) + 0xD800), unit((code - 0x10000) % 1024 + 0xDC00))
            return F.when(code < 127, c).when(code < 0x10000, unit(code)).otherwise(pair)

        out = F.when(text.rlike("[^\\x00-\\x7e]"), F.array_join(F.transform(F.regexp_extract_all(out, F.lit("(?s)."), F.lit(0)), plain), "")).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def python_json(value: Column, kind: T.DataType, sort_keys: bool = False, indent: int | None = None, ascii_only: bool = False, _level: int = 0) -> Column:
    """UD5: a column of type ``kind`` as ``json.dumps(value, sort_keys=..., indent=..., ensure_ascii=ascii_only)``.

    Structs and maps with string keys are objects, other keys of maps are an error; null is
    ``null``; whole numbers, booleans, strings and doubles are what Python writes.  A
    decimal or date has no counterpart there and is an error.
    """
    down = lambda v, t: python_json(v, t, sort_keys, indent, ascii_only, _level + 1)
    glue = ", " if indent is None else ",\n" + " " * indent * (_level + 1)
    begin, end = ("", "") if indent is None else ("\n" + " " * indent * (_level + 1), "\n" + " " * indent * _level)
    # Whether there are any is asked of the value: what is written stands once, so that nesting doesn't double the work at each level.
    wrap = lambda a, of, items, b: F.when(F.size(of) == 0, a + b).otherwise(F.concat(F.lit(a + begin), F.array_join(items, glue), F.lit(end + b)))
    pair = lambda name, shown: F.concat(python_string(name, ascii_only), F.lit(": "), shown)
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name) if sort_keys else kind.fields
        named = [x for f in fields for x in (F.lit(glue), pair(F.lit(f.name), down(value[f.name], f.dataType)))][1:]
        shown = F.concat(F.lit("{" + begin), *named, F.lit(end + "}")) if fields else F.lit("{}")
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.map_entries(value)
        if sort_keys:
            keys = F.sort_array(F.map_keys(value))
            shown = wrap("{", keys, F.transform(keys, lambda k: pair(k, down(value[k], kind.valueType))), "}")
        else:
            shown = wrap("{", value, F.transform(entries, lambda e: pair(e["key"], down(e["value"], kind.valueType))), "}")
    elif isinstance(kind, T.ArrayType):
        shown = wrap("[", value, F.transform(value, lambda e: down(e, kind.elementType)), "]")
    elif isinstance(kind, T.StringType):
        shown = python_string(value, ascii_only)
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        shown = value.cast("string")
    elif isinstance(kind, T.DoubleType | T.FloatType):
        shown = python_float(value.cast("double"))
    elif isinstance(kind, T.NullType):
        shown = F.lit(None).cast("string")
    else:
        raise TypeError(f"no JSON in Python for {kind.simpleString()}")
    return F.coalesce(F.when(value.isNotNull(), shown), F.lit("null"))
