"""Search variants of a query, strategies and routes, as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions import fixed

MOST = 200


def _cut(c: Column) -> Column:
    return F.rtrim(F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(MOST)))


def _first(low: Column, words, value) -> Column:
    """The value of the longest of the words that the text holds."""
    return F.coalesce(*(value(w, low) for w in sorted(words, key=len, reverse=True)))


def _title(word: str) -> str:
    return word.upper() if len(word) <= 3 else word.title()


def filled(template: str, **values: Column) -> Column:
    """A fixed text with the names in braces replaced by columns."""
    return F.concat(*(values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p))


def templates(query: Column, mode: Column, region: Column, country: Column) -> Column:
    """Array of distinct searches: by mode, worldwide where the region is "global", else for the country or the usual two."""
    base = F.trim(query)
    kind = F.when(mode == "product_exact_price", mode).when(mode.isin(*fixed.CONTACT_MODES), "contact").otherwise("other")

    def of(table) -> Column:
        each = lambda ts, c: F.array(*(filled(t, q=base, c=c) for t in ts))
        return F.coalesce(*(F.when(kind == k, each(ts, country)) for k, ts in table.items()))

    usual = F.coalesce(*(F.when(kind == k, F.array(*(filled(t, q=base, c=F.lit(c)) for c in fixed.TEMPLATE_COUNTRIES for t in ts))) for k, ts in fixed.LOCAL_TEMPLATES.items()))
    local = F.when(F.coalesce(country, F.lit("")) != "", of(fixed.LOCAL_TEMPLATES)).otherwise(usual)
    regional = F.coalesce(*(F.when(kind == k, filled(t, q=base)) for k, t in fixed.REGIONAL_TEMPLATE.items()))
    return F.array_distinct(F.when(region == "global", of(fixed.GLOBAL_TEMPLATES)).otherwise(F.concat(local, F.array(regional))))


def _once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def variants(query: Column) -> Column:
    """Array of (pos, kind, text): the distinct search variants of a query, none for a blank one."""
    base = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))
    return _once(F.struct(base.alias("base"), F.lower(base).alias("low")), _variants)


def _variants(q: Column) -> Column:
    """The variants of (base, low)."""
    base, low = q["base"], q["low"]
    of = lambda i: _first(low, fixed.DEVICE_CLASSES, lambda w, q: F.when(F.contains(q, F.lit(w)), fixed.DEVICE_CLASSES[w][i]))
    maker = _first(low, fixed.QUERY_MAKERS, lambda w, q: F.when(q.rlike(rf"\b{re.escape(w)}\b"), _title(w)))
    named = F.filter(F.regexp_extract_all(base, F.lit(fixed.EXPLICIT_MPN), F.lit(0)), lambda m: ~F.lower(m).isin("90s", "80s"))
    told = F.struct(base.alias("base"), of(0).alias("device"), of(1).alias("family"), maker.alias("maker"), F.get(named, 0).alias("named"))
    return F.when(base == "", F.array().cast("array<struct<pos:int,kind:string,text:string>>")).otherwise(_once(told, _made))


def _made(q: Column) -> Column:
    """The distinct variants of (base, device, family, maker, named), the first of each text in any case."""
    base, device = q["base"], q["device"]
    hyde = _cut(filled(fixed.DATASHEET_SENTENCE, device=F.coalesce(device, F.lit("component")), query=base))
    part = F.when(q["named"].isNotNull(), F.concat(q["named"], F.lit(" cross reference equivalent datasheet"))).otherwise(F.concat(F.coalesce(F.concat(q["maker"], F.lit(" ")), F.lit("")), F.coalesce(q["family"], F.lit("series")), F.lit(" "), F.coalesce(device, F.lit("part")), F.lit(" cross reference equivalent")))
    made = {
        "original": base,
        "step_back": F.coalesce(F.concat(device, F.lit(" equivalent replacement cross reference")), F.concat(base, F.lit(" alternative supplier"))),
        "hyde": hyde,
        "query2doc": F.concat_ws(" ", base, hyde),
        "obsolescence": F.concat(base, F.lit(" obsolete EOL NRND NLA LTB superseded by NOS")),
        "mpn_pattern": part,
        "broker_operator": F.concat(base, F.lit(" obsolete stock " + " OR ".join(fixed.BROKER_OPERATORS))),
    }
    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(k).alias("kind"), _cut(v).alias("text")) for i, (k, v) in enumerate(made.items())))

    def once(all_: Column) -> Column:
        low = F.transform(all_, lambda x: F.lower(x["text"]))
        return _once(F.struct(all_.alias("all"), low.alias("low")), lambda a: F.filter(a["all"], lambda x, i: (x["text"] != "") & (F.array_position(a["low"], F.get(a["low"], i)) == i + 1)))

    return _once(rows, once)


def corrective(query: Column, pivots: Column | None = None) -> Column:
    """Array of (kind, text) after an off-target search: brokers, the class, the vocabulary, then at most two of a model's lines."""
    return _once(variants(query), lambda found: _corrective(found, query, pivots))


def _corrective(found: Column, query: Column, pivots: Column | None) -> Column:
    def of(kind: str) -> Column:
        return F.transform(F.filter(found, lambda v: v["kind"] == kind), lambda v: F.struct(v["kind"].alias("kind"), v["text"].alias("text")))

    picks = F.concat(of("broker_operator"), of("step_back"), of("obsolescence"))
    if pivots is None:
        return picks
    lines = F.transform(F.split(F.coalesce(pivots, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[-*0-9.) ]+", ""), r"\s+", " ")))
    lines = F.slice(F.filter(lines, lambda x: (x != "") & (F.length(x) <= MOST)), 1, 2)
    fresh = F.filter(F.array_distinct(lines), lambda x: (F.lower(x) != F.lower(query)) & ~F.exists(picks, lambda p: F.lower(p["text"]) == F.lower(x)))
    return F.concat(picks, F.transform(fresh, lambda x: F.struct(F.lit("pivot").alias("kind"), x.alias("text"))))


def strategies(mode: Column) -> Column:
    return F.when(mode.isin(*fixed.SERVICE_MODES), F.array(*map(F.lit, fixed.SERVICE_STRATEGIES))).otherwise(F.array(*map(F.lit, fixed.ELECTRONICS_STRATEGIES)))


def strategy_queries(strategy: Column, query: Column, most: int = 2) -> Column:
    table = F.create_map(*[x for k, v in fixed.STRATEGY_QUERIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.transform(F.slice(F.coalesce(F.element_at(table, strategy), F.array(F.lit("{q}"))), 1, most), lambda t: F.replace(t, F.lit("{q}"), query))


def reasons(mode: Column, confidence: Column, enabled: bool = True, below: float = 0.75) -> Column:
    """Whether the reasoning layer is asked for."""
    return F.lit(enabled) & mode.isin(*fixed.REASONING_MODES) & (confidence < below)


def tier(task: Column, high_risk: Column) -> Column:
    """(tier, escalated): planning and high risk go to the larger model."""
    planned = F.coalesce(task.isin(*fixed.PLANNED_TASKS), F.lit(False))
    return F.struct(F.when(high_risk | planned, "max").otherwise("flash").alias("tier"), (high_risk & ~planned).alias("escalated"))


def rfq_email(query: Column, vendor: Column, channel: Column, value: Column) -> Column:
    """The fixed letter; empty without a channel."""
    via = F.when(channel == "contact_email", F.concat(F.lit(" (sent to "), value, F.lit(")"))).otherwise("")
    letter = F.concat(filled(fixed.RFQ_LETTER, vendor=vendor, query=query), via)
    return F.when(channel.isNull(), "").otherwise(letter)


def skill_match(skeleton: Column, template: Column) -> Column:
    """Jaccard similarity of the tokens of two masked queries."""
    a, b = F.array_distinct(F.split(skeleton, " ")), F.array_distinct(F.split(template, " "))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))
