"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base matches (email, ip, card, phone) are the seeds. Number-like and @-like strings of all texts are instances; each
occurrence has up to three lexical patterns: the word before with the instance's shape, the shape with the word after,
and the two words before with the word after. Patterns and instances form a graph that is scored in rounds:

- a pattern by the mean score of its distinct instances (smoothed by one); it is trusted from ``confidence`` on, if at
  least ``seeds`` of its instances are accepted, and is of the kind that most of these have;
- an instance that no rule validates by the noisy-or of its trusted patterns of one kind; with a score of
  ``confidence`` it is accepted and counts for its patterns like a seed from the next round on.

So patterns reached only through discovered instances induce and discover in turn. Rounds end when none is accepted.
Every occurrence of an accepted instance that overlaps no base span is added under its kind. Base spans always stay.

The graph is aggregated before it is joined, all rounds are written to the shared folder, and nothing is collected.
Ties of kinds go to the one listed first. Null text is empty text: no spans. Rows are told apart by position, so
repeated rows and null doc_ids keep a result each; repeated occurrences are one instance of the graph. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import small, written
from provena.llm.native import by_kind, count_of, joined, overlapped, spans, tagged

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the base patterns: the same matches in linear time and without recursion on long texts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}"
CARD = r"[0-9](?<![0-9]{2})(?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
INSTANCE = r"(?:(?<![0-9+(])[+(]?[0-9](?:[ ().-]{0,2}+[0-9])++)|(?:(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++@[A-Za-z0-9._%+@-]++)"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CONFIDENCE, SEEDS, MIN_DIGITS, CONTEXT = 0.8, 5, 7, 40


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _card(x: Column) -> Column:
    digits = F.translate(x["v"], " -", "")
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def base(text: Column) -> dict[str, Column]:
    """The base spans of each kind; ``text`` must not be null."""
    digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<s:int,e:int,v:string,l:string,r:string>>")
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(none),
        "ip": F.when(digit, F.filter(spans(text, IP), lambda x: x["v"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))).otherwise(none),
        "card": F.when(digit, F.filter(spans(text, CARD), _card)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), lambda x: F.length(F.regexp_replace(x["v"], "[^0-9]", "")).between(9, 15))).otherwise(none),
    }


_FOUND = "array<struct<s:int,e:int,instance:bigint,patterns:array<string>>>"


def _instances(text: Column) -> Column:
    """Candidates with their patterns; a pattern without any word is none."""
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    found = F.filter(spans(text, INSTANCE, CONTEXT), lambda x: F.contains(x["v"], F.lit("@")) | (digits(x["v"]) >= MIN_DIGITS))
    shape = lambda v: F.substring(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "9"), "[A-Za-z]+", "a"), 1, 60)
    bare = lambda w: F.regexp_replace(w, r"^\W+|\W+$", "")

    def item(x: Column) -> Column:
        before, after = F.split(F.rtrim(F.lower(x["l"])), r"\s+"), F.split(F.ltrim(F.lower(x["r"])), r"\s+")
        one, two, next_one = bare(F.element_at(before, -1)), bare(F.coalesce(F.get(before, F.size(before) - 2), F.lit(""))), bare(F.get(after, 0))
        patterns = F.array(F.when(one != "", F.concat(F.lit("b|"), one, F.lit("|"), shape(x["v"]))), F.when(next_one != "", F.concat(F.lit("a|"), shape(x["v"]), F.lit("|"), next_one)), F.when((one != "") & (two != "") & (next_one != ""), F.concat(F.lit("c|"), two, F.lit(" "), one, F.lit("|"), next_one)))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.xxhash64(x["v"]).alias("instance"), F.array_compact(patterns).alias("patterns"))

    return F.transform(found, item).cast(_FOUND)


def scored(edges: DataFrame, seeds_of: DataFrame, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """(instance, k, score) of the accepted instances, from the graph ``edges`` (pattern, instance) and its seeds (instance, k).

    ``k`` is the kind's place. Seeds have score 1; others keep the kind and score that they were accepted with.
    """
    accepted = written(seeds_of.withColumn("score", F.lit(1.0)), "accepted")
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= seeds), "patterns")
    able = written(edges.join(sizes, "pattern").select("pattern", "instance", "n"), "able")
    while True:
        held = accepted.hint("broadcast") if small(accepted, 32) else accepted
        by_kind = able.join(held, "instance").groupBy("pattern", "k").agg(F.sum("score").alias("score"), F.count("*").alias("m"), F.first("n").alias("n"))
        patterns = by_kind.groupBy("pattern").agg(F.max(F.struct("m", (-F.col("k")).alias("k")))["k"].alias("k"), F.sum("m").alias("m"), F.sum("score").alias("score"), F.first("n").alias("n"))
        patterns = patterns.select("pattern", (-F.col("k")).cast("int").alias("k"), (F.col("score") / (F.col("n") + 1)).alias("confidence"), "m")
        trusted = written(patterns.where((F.col("confidence") >= confidence) & (F.col("m") >= seeds)).select("pattern", "k", "confidence"), "trusted")
        told = able.select("pattern", "instance").join(F.broadcast(trusted) if small(trusted, 128) else trusted, "pattern")
        fresh = told.join(accepted.select("instance"), "instance", "left_anti").groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        fresh = fresh.groupBy("instance").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("x")).select("instance", (-F.col("x.k")).cast("int").alias("k"), F.col("x.score").alias("score")).where(F.col("score") >= confidence)
        fresh = written(fresh, "fresh")
        if fresh.isEmpty():
            return accepted
        accepted = written(accepted.unionByName(fresh), "accepted")


def _clear(table: DataFrame) -> DataFrame:
    """(rid, s, e, instance, patterns, k): every candidate with the kind's place of a base span that it overlaps, else null."""
    none = F.lit(None)
    mine = table.where(F.size("instances") > 0).select("rid", F.explode("instances").alias("x")).select("rid", "x.s", "x.e", "x.instance", "x.patterns", none.cast("int").alias("k"))
    theirs = table.where((F.size("instances") > 0) & (F.size("base") > 0)).select("rid", F.explode("base").alias("b")).select("rid", "b.s", "b.e", none.cast("long").alias("instance"), none.cast("array<string>").alias("patterns"), "b.k")
    both = mine.unionByName(theirs).withColumn("over", overlapped(F.col("k").isNotNull()))
    return both.where("k is null").select("rid", "s", "e", "instance", "patterns", F.col("over").alias("k"))


def find(docs: DataFrame, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """Per document (doc_id, base, added): arrays of (k, kind, s, e)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = docs.select("doc_id", text.alias("text"))
    table = table.select("doc_id", F.concat(*(tagged(kind, k, c) for k, (kind, c) in enumerate(base(F.col("text")).items()))).alias("base"), F.when(F.col("text").rlike("[0-9@]"), _instances(F.col("text"))).otherwise(F.array().cast(_FOUND)).alias("instances"))
    table = written(table.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "base", "instances"), "spans")
    at = written(_clear(table), "instances_at")
    edges = written(at.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "graph")
    accepted = scored(edges, at.where("k is not null").groupBy("instance").agg(F.min("k").alias("k")), confidence, seeds)
    added = at.where("k is null").drop("k").join(accepted.select("instance", "k"), "instance")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    added = added.select("rid", F.struct("k", kind.alias("kind"), "s", "e").alias("x")).groupBy("rid").agg(F.collect_list("x").alias("added"))
    return table.join(added, "rid", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<k:int,kind:string,s:int,e:int>>")).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans, from ``find``."""
    counts = (count_of(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS))
    return found.select("doc_id", *counts, F.sha2(joined(by_kind(F.col("base"))), 256).alias("base_sha256"), joined(by_kind(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
