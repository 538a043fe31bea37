"""Model replies as JSON, whatever stands around it or is wrong inside: column expressions only.

A text is cut into its quoted strings and what lies between them by one pattern, so
strings can be mended, or hidden while braces are counted, without a loop over characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import strip

# What a quote that ends a string is followed by; code fences.
_FOLLOWS = r"[ \t\r\n]*(?:[,}\]:]|\z)"
FENCE = r"(?m)^\s*```(?:json)?\s*|\s*```\s*$"
LAZY_FENCE, GREEDY_FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)```(?:json)?\s*(\{.*\})\s*```"

#: A string that ends at a quote with structure behind it; and one that ends at its first quote, or never.
MENDED = r'(?s)"(?:[^"\\]++|\\.|"(?!' + _FOLLOWS + r'))*+"'
PLAIN = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)'
#: Stands before a character that no backslash escapes.
_BARE = r"(?<=(?<!\\)(?:\\\\){0,200})"


def _parse(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing behind it; the parser itself stops at the first value's end."""
    parse = lambda c: F.call_function("try_parse_json", c)
    one = parse(F.concat(F.lit("["), text, F.lit("]")))
    alone = (F.size(one.cast("array<variant>")) == 1) & parse(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(alone, F.call_function("variant_get", one, F.lit("$[0]"), F.lit("variant")))


def _in_strings(text: Column, pattern: str, change) -> Column:
    """The text with ``change`` applied to what ``pattern`` finds, and nothing else."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(change(b), F.lit("")))), "")


def repair_inner_quotes(text: Column) -> Column:
    """quotes within a string are escaped, and raw line breaks there.

    A quote ends its string only if the next character but white space is one of ``, } ] :``
    or there is none.
    """

    def mend(found: Column) -> Column:
        body = F.substr(found, F.lit(2), F.length(found) - 2)
        body = F.regexp_replace(body, _BARE + '"', r'\\"')
        body = F.regexp_replace(F.regexp_replace(body, _BARE + "\n", r"\\n"), _BARE + "\r", r"\\r")
        return F.concat(F.lit('"'), body, F.lit('"'))

    return _in_strings(text, MENDED, mend)


def outermost_object(text: Column) -> Column:
    """From the first brace to the one that balances it; braces in strings don't count; null without such."""
    tail = F.substr(text, F.instr(text, F.lit("{")))
    hidden = _in_strings(tail, PLAIN, lambda s: F.repeat(F.lit("x"), F.length(s)))
    pieces = F.split(hidden, r"\}", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))  # what each closing brace ends
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.lit(False).alias("whole"))

    def close(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.length(F.regexp_replace(piece, r"[^{]", "")) - 1
        return F.when(state["whole"], state).otherwise(F.struct(depth.alias("depth"), (state["chars"] + F.length(piece) + 1).alias("chars"), (depth == 0).alias("whole")))

    end = F.aggregate(pieces, start, close)
    return F.when(F.instr(text, F.lit("{")) > 0, F.when(end["whole"], F.substr(tail, F.lit(1), end["chars"])))


def extract_json(reply: Column) -> Column:
    """F1, UD2: a reply's JSON as VARIANT: without fences; with mended quotes; the outermost object; that mended. Else null.

    Objects with a key twice are null, as VARIANT has them.
    """
    text = strip(F.regexp_replace(reply, FENCE, ""))
    inner = outermost_object(text)
    return F.when(reply != "", F.coalesce(_parse(text), _parse(repair_inner_quotes(text)), _parse(inner), _parse(repair_inner_quotes(inner))))


def fenced_json(reply: Column, greedy: bool = False) -> Column:
    """the object in a fence, up to its first or (greedy) last closing brace before a fence, or from the first brace to the last, as VARIANT."""
    text = strip(F.coalesce(reply, F.lit("")))
    fenced = F.regexp_extract(text, GREEDY_FENCE if greedy else LAZY_FENCE, 1)
    whole = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return _parse(F.when(fenced != "", fenced).when(whole != "", whole))
