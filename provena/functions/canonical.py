"""Canonical JSON as Catalyst expressions: keys in order of code points at every depth, one form for each number and string.

The form is that of a dump with sorted keys, ", " and ": " between, and characters beyond ASCII as they are. Whole
numbers keep their digits, whatever their size; others are the shortest decimal that names the same double, with an
exponent below 1e-4 and from 1e16 on. A text that is no JSON, or that repeats a key in an object, has no canonical form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokens of JSON: strings, numbers, and what stands between them.
_STRING = r'"(?:[^"\\]++|\\[\s\S])*+"'
_NUMBER = r"-?\d++(?:\.\d++)?+(?:[eE][+-]?\d++)?+"
_TOKENS = rf'{_STRING}|{_NUMBER}|[^"\d-]++|["-]'


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def brackets(text: Column) -> Column:
    """The brackets of a text of JSON, all of one kind: what nests in it."""
    return F.translate(F.regexp_replace(text, _STRING + r"|[^\[\]{}\"]++", ""), "{}", "[]")


def depth(nested: Column) -> Column:
    """How deep such brackets nest."""
    step = lambda a, c: F.struct((a["at"] + F.when(c == "[", 1).otherwise(-1)).alias("at"), F.greatest(a["most"], a["at"] + F.when(c == "[", 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(nested, ""), lambda c: c.isin("[", "]")), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda a: a["most"])


def quoted(text: Column) -> Column:
    """A string as JSON: quotes, backslashes and control characters are escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    controls = out
    for c in range(32):
        controls = F.replace(controls, F.lit(chr(c)), F.lit(short.get(c, f"\\u{c:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), controls).otherwise(out), F.lit('"'))


def _parts(text: Column) -> Column:
    """(digits, point) of a decimal text: its significant digits, and how many of them stand before the point."""
    mantissa = F.regexp_extract(text, r"^-?([\d.]+)", 1)
    exponent = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"[eE]\+?(-?\d+)$", 1), F.lit("")), F.lit("S999999999")).cast("long"), F.lit(0).cast("long"))
    whole = F.regexp_extract(mantissa, r"^(\d+)", 1)
    joined = F.replace(mantissa, F.lit("."), F.lit(""))
    bare = F.regexp_replace(joined, "^0+", "")
    return F.struct(F.regexp_replace(bare, "0+$", "").alias("digits"), (F.length(whole) - (F.length(joined) - F.length(bare)) + exponent).alias("point"))


def _shaped(negative: Column, digits: Column, point: Column) -> Column:
    """The digits with their point, or with an exponent of two places at least."""
    n, power = F.length(digits), point - 1
    tail = F.concat(F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    count = point.cast("int")
    plain = (
        F.when(count <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -count), digits))
        .when(count >= n, F.concat(digits, F.repeat(F.lit("0"), count - n), F.lit(".0")))
        .otherwise(F.concat(F.left(digits, count), F.lit("."), F.substring(digits, count + 1, n)))
    )
    return F.concat(F.when(negative, "-").otherwise(""), F.when((power < -4) | (power >= 16), F.concat(F.left(digits, F.lit(1)), tail)).otherwise(plain))


def number(text: Column) -> Column:
    """A number of JSON in its one form."""
    value, negative = text.cast("double"), F.startswith(text, F.lit("-"))

    def of_double(given: Column) -> Column:
        # Up to fifteen digits name one double and no shorter ones do; of more, the fewest that come back are taken.
        tries = [F.format_string(f"%.{p - 1}e", value) for p in (15, 16, 17)]
        best = F.coalesce(*(F.when(t.cast("double") == value, t) for t in tries), value.cast("string"))
        return F.when(F.length(given["digits"]) <= 15, _shaped(negative, given["digits"], given["point"])).otherwise(_let(_parts(best), lambda b: _shaped(negative, b["digits"], b["point"])))

    real = F.when(value == 0, F.concat(F.when(negative, "-").otherwise(""), F.lit("0.0"))).when(F.abs(value) == float("inf"), F.concat(F.when(negative, "-").otherwise(""), F.lit("Infinity"))).otherwise(_let(_parts(text), of_double))
    return F.when(text.rlike("[.eE]"), real).otherwise(F.when(text == "-0", "0").otherwise(text))


def _string(token: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(token), "$", "string")


def parsed(text: Column) -> Column:
    """The variant of a text in which every string and number has become a string: its own canonical text.

    A variant would not keep a number's form, and this way nothing is left to do for what it holds. Null if no JSON.
    """

    def own(t: Column) -> Column:
        # Plain strings and whole numbers are their own form; a token that is none stays, and the text is no JSON.
        plain = F.concat(F.lit('"\\"'), F.substring(t, F.lit(2), F.length(t) - 2), F.lit('\\""'))
        string = F.when(~t.rlike(r"[\x00-\x1f\\]"), plain).when(F.contains(t, F.lit("\\")) & ~t.rlike("[\\x00-\\x1f]"), quoted(quoted(_string(t))))
        whole = F.when(t == "-0", '"0"').otherwise(F.concat(F.lit('"'), t, F.lit('"')))
        real = F.when(t.rlike(r"^-?(?:0|[1-9]\d*)(?:[.eE]|$)"), F.concat(F.lit('"'), number(t), F.lit('"')))
        return F.when(F.startswith(t, F.lit('"')), string).when(t.rlike(r"^-?(?:0|[1-9]\d*)$"), whole).when(t.rlike(r"^-?\d"), real)

    tokens = F.transform(F.regexp_extract_all(text, F.lit(f"({_TOKENS})"), F.lit(1)), lambda t: F.coalesce(own(t), t))
    return F.try_parse_json(F.array_join(tokens, ""))


def form(value: Column, levels: int) -> Column:
    """The canonical text of such a variant, of at most ``levels`` levels of arrays and objects."""
    kind, text = F.left(F.schema_of_variant(value), F.lit(3)), F.try_variant_get(value, "$", "string")
    scalar = F.coalesce(text, F.lit("null"))
    if levels == 0:
        return scalar
    bare = lambda k: F.when(F.contains(k, F.lit("\\")), _string(k)).otherwise(F.substring(k, F.lit(2), F.length(k) - 2))
    before = lambda a, b: F.when(bare(a["key"]) < bare(b["key"]), -1).when(a["key"] == b["key"], 0).otherwise(1)
    fields = F.transform(F.array_sort(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), before), lambda e: F.struct(F.concat(e["key"], F.lit(": ")).alias("key"), e["value"].alias("value")))
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.struct(F.lit("").alias("key"), v.alias("value")))
    inner = F.array_join(F.transform(F.when(kind == "OBJ", fields).otherwise(listed), lambda e: F.concat(e["key"], form(e["value"], levels - 1))), ", ")
    opened, closed = F.when(kind == "OBJ", "{").otherwise("["), F.when(kind == "OBJ", "}").otherwise("]")
    return F.when(kind.isin("OBJ", "ARR"), F.concat(opened, inner, closed)).otherwise(scalar)


def dump(text: Column, levels: int) -> Column:
    """The canonical form of a text of JSON of at most ``levels`` levels; null if it is none."""
    return _let(parsed(text), lambda v: F.when(v.isNotNull(), form(v, levels)))
