"""Skill cards: text with a head of settings between lines of dashes, and sections under headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DASHES = "---"


def _taken(lines: Column, first: Column, last: Column) -> Column:
    """The lines from ``first`` to ``last``, both counted from 1 and included, as text."""
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _split_head(text: Column) -> Column:
    """(head, body): what stands between a first line of dashes and the next such line, and the lines after it."""

    def cut(lines: Column) -> Column:
        bare = F.transform(lines, lambda x: F.rtrim(x))
        closing = F.array_position(F.slice(bare, F.lit(2), F.size(bare)), _DASHES)  # 0: none
        headed = (F.get(bare, 0) == _DASHES) & (closing > 0)
        return F.struct(F.when(headed, _taken(lines, F.lit(2), closing)).otherwise("").alias("head"), F.when(headed, _taken(lines, closing + 2, F.size(lines))).otherwise(F.array_join(lines, "\n")).alias("body"))

    return _let(F.split(text, "\n"), cut)


def _setting(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", ""), F.lit(""))


def _listed(head: Column, *names: str) -> Column:
    """A list in brackets or of dashed lines; empty without one."""
    none = F.array().cast("array<string>")
    out = none
    for name in reversed(names):
        inline = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$", 1)
        lines = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1)
        bare = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(F.trim(x), "^[-\"' \t]+|[\"' \t]+$", "")), lambda x: x != "")
        out = F.when(inline != "", bare(F.split(inline, ","))).when(lines != "", bare(F.split(lines, "\n"))).otherwise(out)
    return out


def _section(body: Column, heading: str) -> Column:
    """The lines under the first heading of that name, up to the next heading of any."""

    def walk(lines: Column) -> Column:
        level = F.transform(lines, lambda x: F.length(x) - F.length(F.ltrim(x, F.lit("#"))))
        heads = F.transform(lines, lambda x, i: F.get(level, i).between(1, 6) & F.startswith(F.ltrim(x, F.lit("#")), F.lit(" ")))
        named = F.transform(lines, lambda x, i: F.get(heads, i) & (F.lower(F.trim(F.ltrim(x, F.lit("#")))) == heading.lower()))
        start = F.array_position(named, True)
        ends = F.array_position(F.slice(heads, start + 1, F.size(heads)), True)
        return F.when(start == 0, "").otherwise(_taken(lines, start + 1, F.when(ends == 0, F.size(lines)).otherwise(start + ends - 1)))

    return F.regexp_replace(_let(F.split(body, "\n"), walk), r"^\s+|\s+$", "")


def parsed(cards: DataFrame) -> DataFrame:
    """(source, name, description, keywords, allowed_tools, instructions, examples) of cards (source, text).

    Without a head the name is the source and the description the first line of prose; without a section of
    instructions the whole body is them.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n")
    rows = cards.select("source", _split_head(text).alias("parts")).select("source", "parts.head", "parts.body")
    head, body = F.col("head"), F.col("body")
    prose = F.get(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), 0)
    instructions = _section(body, "Instructions")
    return rows.select(
        "source", F.coalesce(_setting(head, "name"), "source").alias("name"), F.coalesce(_setting(head, "description"), prose, F.lit("")).alias("description"), _listed(head, "keywords").alias("keywords"),
        _listed(head, "allowedTools", "allowed_tools").alias("allowed_tools"), F.when(instructions != "", instructions).otherwise(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("instructions"), _section(body, "Examples").alias("examples"),
    )


def read(spark: SparkSession, root: str) -> DataFrame:
    """The cards of ``root``: a folder each, named after its source, with a file SKILL.md."""
    raw = spark.read.text(f"{root}/*/SKILL.md", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return parsed(raw.select(F.element_at(F.split("path", "/"), -2).alias("source"), F.col("value").alias("text")))
