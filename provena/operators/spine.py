"""The verification spine: claims against the page that they cite, then against the other pages of their run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import fixed, grounding, scores
from provena.functions import text as T

#: Characters of a snippet on either side of its span; corroborating pages that count at most.
AROUND, CORROBORATIONS = 180, 3


def span(text: Column, match: Column, fallbacks: tuple[str, ...] = ()) -> Column:
    """(start, end, span, snippet): the first place of ``match``, in any case, else of a fallback; -1 where none is."""
    body, low = F.coalesce(text, F.lit("")), F.lower(F.coalesce(text, F.lit("")))
    target = F.trim(F.coalesce(match, F.lit("")))

    def found(term: Column) -> Column:
        at = F.when(term != "", F.position(F.lower(term), low))
        start = at - 1
        first = F.greatest(F.lit(0), start - AROUND)
        snippet = F.trim(F.substring(body, first + 1, start + F.length(term) + AROUND - first))
        return F.when(at > 0, F.struct(start.alias("start"), (start + F.length(term)).alias("end"), F.substring(body, at, F.length(term)).alias("span"), snippet.alias("snippet")))

    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), target.alias("span"), target.alias("snippet"))
    return F.coalesce(found(target), *(found(F.lit(t)) for t in fallbacks), none)


def claim_rows(pages: DataFrame, keys: list[str], field: str, match: Column, fallbacks: tuple[str, ...] = ()) -> DataFrame:
    """(keys, claim_id, field, start, end, span, span_hash, snippet, confidence): an evidence row for each page with a snippet."""
    rows = pages.withColumn("_x", span(F.col("text"), match, fallbacks)).where(F.col("_x.snippet") != "")
    name = F.concat_ws(":", F.col("id").cast("string"), F.lit(field), F.col("_x.start").cast("string"), F.col("_x.end").cast("string"), F.col("_x.span"))
    claim_id = F.concat(F.lit("claim_"), F.left(F.sha2(name.cast("binary"), 256), F.lit(12)))
    placed = F.when(F.col("_x.start") >= 0, F.sha2(F.col("_x.span").cast("binary"), 256))
    return rows.select(*keys, claim_id.alias("claim_id"), F.lit(field).alias("field"), "_x.start", "_x.end", "_x.span", placed.alias("span_hash"), "_x.snippet", F.lit(0.75).alias("confidence"))


def _tokens(c: Column) -> Column:
    """What a value and a page that may support it share: numbers as numbers, and words."""
    numbers = F.transform(F.regexp_extract_all(T.premise(c), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: F.concat(F.lit("#"), n.cast("double").cast("string")))
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(fixed.CLAIM_TOKEN), F.lit(0))
    return F.array_distinct(F.concat(numbers, words, F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))))


def verify(claims: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, claim_id, verified, score, stage, label, decision, grade, corroborations).

    ``claims``: by, claim_id, subject, predicate, value, page (the cited id). ``pages``: by, id, url, text. Other pages
    of the run meet a claim on the tokens of its value, and are checked if they hold a quarter of them; one that has
    the value only inside a longer word is not met. Corroborating pages are counted, three at most.

    What a check says depends on claim and text alone: claims that say the same meet each text of their run once, with
    the number of pages that have it, and the cited page is taken off again. Nothing is broadcast: sizes of exploded
    sides are not known from their files.
    """
    check = lambda text: grounding.check(F.col("predicate"), F.col("value"), text, F.col("subject"))
    meets = lambda hits, n: (hits > 0) & (hits * 4 >= n)
    what = claims.withColumn("_kind", F.md5(F.to_json(F.struct("subject", "predicate", "value")).cast("binary")))
    cited = what.join(pages.select(*by, F.col("id").alias("page"), "url", F.col("text").alias("span")).hint("merge"), [*by, "page"], "left")
    cited = cited.withColumn("first", check(F.col("span")))
    held = F.size(F.array_intersect(_tokens(F.col("value")), _tokens(F.col("span"))))
    cited = cited.withColumn("_own", F.coalesce(F.col("url").isNotNull() | F.col("span").isNotNull(), F.lit(False)) & F.coalesce(meets(held, F.size(_tokens(F.col("value")))), F.lit(False)))
    kinds = what.select(*by, "_kind", "subject", "predicate", "value").dropDuplicates([*by, "_kind"])
    texts = pages.where(F.col("text").isNotNull()).groupBy(*by, "text").agg(F.count("*").alias("pages")).withColumn("_text", F.md5(F.col("text").cast("binary")))
    wanted = kinds.select(*by, "_kind", _tokens(F.col("value")).alias("t")).select(*by, "_kind", F.size("t").alias("n"), F.explode("t").alias("k"))
    pairs = wanted.join(texts.select(*by, "_text", F.explode(_tokens(F.col("text"))).alias("k")).hint("merge"), [*by, "k"])
    pairs = pairs.groupBy(*by, "_kind", "_text").agg(F.count("*").alias("hits"), F.first("n").alias("n")).where(meets(F.col("hits"), F.col("n")))
    told = pairs.join(kinds.hint("merge"), [*by, "_kind"]).join(texts.hint("merge"), [*by, "_text"]).select(*by, "_kind", "pages", check(F.col("text")).alias("r"))
    told = told.groupBy(*by, "_kind", F.col("r.score").alias("score")).agg(F.sum("pages").alias("pages"), F.coalesce(F.sum(F.when(F.col("r.supported"), F.col("pages"))), F.lit(0)).alias("supported"))
    # The two best scores: without the cited page the second may be the best.
    told = told.groupBy(*by, "_kind").agg(F.sum("supported").alias("all"), F.slice(F.sort_array(F.collect_list(F.struct("score", "pages")), False), 1, 2).alias("top"))
    out = cited.join(told.hint("merge"), [*by, "_kind"], "left")
    supported, own = F.col("first.supported"), F.col("_own")
    others = F.coalesce("all", F.lit(0)) - F.when(own & supported, 1).otherwise(0)
    alone = own & (F.get("top", 0)["score"] == F.col("first.score")) & (F.get("top", 0)["pages"] == 1)
    best = F.when(alone, F.get("top", 1)["score"]).otherwise(F.get("top", 0)["score"])
    elsewhere = others > 0
    label = grounding.label(supported, elsewhere, F.col("subject"), F.col("value"), F.col("span"))
    out = out.withColumns({"label": label, "corroborations": F.least(F.lit(CORROBORATIONS), others).cast("int")})
    prior = F.coalesce(T.reliability(T.source_class(F.coalesce("url", F.lit("")), F.coalesce("span", F.lit("")))), F.lit(0.4))
    exact = T.value_grounded(F.col("value"), F.col("span"))
    spans = F.when(F.col("label") == "grounded", F.col("corroborations") + 1).otherwise(1)
    grade = scores.grade(prior, exact, F.col("label"), F.lit(None).cast("double"), spans)
    score = F.when(supported, F.col("first.score")).otherwise(F.greatest(F.col("first.score"), F.coalesce(best, F.lit(0.0))))
    return out.select(*by, "claim_id", (supported | elsewhere).alias("verified"), score.alias("score"), F.when(supported, "cited").otherwise("corpus").alias("stage"), "label", scores.grounding_decision(F.col("label")).alias("decision"), grade.alias("grade"), "corroborations")


def compose(ranked: DataFrame, by: list[str], score: str, seq: str) -> DataFrame:
    """(by, primary, substitutes, others, overall): a run's slots from its candidates, best first.

    Each row's place is a rank; the lists are those of one run's candidates.
    """
    place = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(seq))
    rows = ranked.withColumn("_n", F.row_number().over(place)).withColumn("_top", F.max(score).over(Window.partitionBy(*by)))
    share = F.round(F.when(F.col("_top") > 0, F.col(score) / F.col("_top")).otherwise(0.0) * 10_000).cast("long")  # whole numbers: sums don't depend on order
    slot = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("_n", seq)))), lambda x: x[seq])
    return rows.groupBy(*by).agg(F.max(F.when(F.col("_n") == 1, F.col(seq))).alias("primary"), slot(F.col("_n").between(2, 4)).alias("substitutes"), slot(F.col("_n") > 4).alias("others"), F.coalesce(F.round(F.sum(F.when(F.col("_n") > 1, share)) / F.nullif(F.count("*") - 1, F.lit(0))) / 10_000, F.lit(0.0)).alias("overall"))
