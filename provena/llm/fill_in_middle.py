"""Fill-in-middle by relational units: texts are cut between units, and the three parts put in another order.

The units of a text are the matches of a pattern that cover it from left to right. They are exploded with their places,
``run`` of them to a row; windows over a document's rows sum up the units and characters before each; a document's cut
requests, which name units by ordinal, are joined to the row that holds the unit; the offsets are aggregated by document
and the text is cut there with substring. A row keeps its units' lengths only where they differ, so that a text of
single characters leaves two numbers for each ``run`` of them.

A document is a (doc_id, text): equal rows share their requests and offsets, and each of them is returned. Null text is
empty text. A null doc_id counts as an empty string where its hash is taken. Empty texts, and texts that hold a mark,
are plain. An empty table has no rows. Other columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is one code point, any.
CODE_POINT = r"[\s\S]"
#: Units of an exploded row; single characters need no more of a row than their number.
RUN, CODE_POINTS = 256, 1 << 14
PLAIN_FROM, SPM_BELOW = 90, 20


def runs(docs: DataFrame, unit: str, run: int) -> DataFrame:
    """(key, pos, units, chars, lengths, doc_id): a row for each ``run`` consecutive units of the documents (doc_id, key, text)."""
    single = unit == CODE_POINT
    pieces = F.posexplode(F.regexp_extract_all("text", F.lit(f"{unit if single else f'(?:{unit})'}{{1,{run}}}+"), F.lit(0))).alias("pos", "piece")
    rows = docs.select("key", "doc_id", pieces)
    if single:
        sized = rows.select("key", "doc_id", "pos", F.length("piece").alias("units"), F.length("piece").alias("chars"), F.lit(None).cast("array<int>").alias("lengths"))
    else:
        lengths = F.transform(F.regexp_extract_all("piece", F.lit(f"({unit})"), F.lit(1)), lambda x: F.length(x))
        sized = rows.select("key", "doc_id", "pos", lengths.alias("l"), F.length("piece").alias("chars"))
        even = F.array_min("l") == F.array_max("l")
        sized = sized.select("key", "doc_id", "pos", F.size("l").alias("units"), "chars", F.when(~even, F.col("l")).alias("lengths"))
    # Equal documents have equal runs: one of each is kept, before and after the shuffle.
    return sized.groupBy("key", "pos").agg(F.max("units").cast("long").alias("units"), F.max("chars").cast("long").alias("chars"), F.first("lengths").alias("lengths"), F.max("doc_id").alias("doc_id"))


def offsets(units: DataFrame, requests: DataFrame, run: int) -> DataFrame:
    """(key, cut, offset): characters before the unit of ordinal ``at``, for ``requests`` (key, cut, at).

    Every row but a document's last holds ``run`` units, so a request is joined to its row by at // run. A request for
    the place after the last unit has no such row where the last is full: it is after all rows before it.
    """
    by = Window.partitionBy("key").orderBy("pos")
    summed = units.withColumn("upto", F.sum("chars").over(by))
    inner = F.col("at") - F.col("pos") * run
    inside = F.when(F.col("lengths").isNotNull(), F.aggregate(F.slice("lengths", F.lit(1), inner.cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(inner * F.col("chars") / F.col("units")).cast("long")
    # The row of the unit before the cut always exists but for a cut at 0.
    wanted = requests.where("at > 0").withColumn("pos", F.floor((F.col("at") - 1) / run).cast("int"))
    found = wanted.join(summed, ["key", "pos"]).select("key", "cut", (F.col("upto") - F.col("chars") + inside).alias("offset"))
    return found.unionByName(requests.where("at = 0").select("key", "cut", F.lit(0).cast("long").alias("offset")))


def hashed(doc_id: Column, i: int) -> Column:
    """The i-th group of eight digits (from 1) of the hexadecimal sha256 of ``1:`` and doc_id, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, unit: str = CODE_POINT, run: int | None = None) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) of ``docs`` (doc_id, text): n units, the parts null where plain."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.unhex(F.md5(F.concat(name, F.lit(":"), "text").cast("binary"))))
    run = run or (CODE_POINTS if unit == CODE_POINT else RUN)
    units = written(runs(docs, unit, run), "units")
    marked = F.greatest(*(F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)))
    ids = F.col("doc_id")
    totals = units.groupBy("key").agg(F.sum("units").alias("n"), F.max("doc_id").alias("doc_id"))
    places = [F.pmod(hashed(ids, i), F.col("n") + 1) for i in (1, 2)]
    cuts = totals.select("key", F.explode(F.array(F.struct(F.lit("low").alias("cut"), F.least(*places).alias("at")), F.struct(F.lit("high").alias("cut"), F.greatest(*places).alias("at")))).alias("r")).select("key", "r.*")
    placed = offsets(units, cuts, run)
    # Offsets and the number of units, by document.
    none = F.lit(None).cast("long")
    wide = placed.select("key", none.alias("n"), F.when(F.col("cut") == "low", F.col("offset")).alias("low"), F.when(F.col("cut") == "high", F.col("offset")).alias("high"))
    wide = wide.unionByName(totals.select("key", "n", none.alias("low"), none.alias("high")))
    wide = wide.groupBy("key").agg(F.max("n").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"))
    rows = docs.join(wide.hint("shuffle_hash"), "key", "left").select("doc_id", "text", F.coalesce("n", F.lit(0)).alias("n"), "low", "high")
    plain = (F.col("n") == 0) | marked | (F.pmod(hashed(ids, 3), F.lit(100)) >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.pmod(hashed(ids, 4), F.lit(100)) < SPM_BELOW, "spm").otherwise("psm")
    part = lambda start, size: F.when(F.col("form") != "plain", F.substring(F.col("text"), start, size))
    low, high = F.col("low").cast("int"), F.col("high").cast("int")
    rows = rows.withColumn("form", form).withColumns({"prefix": part(F.lit(1), low), "middle": part(low + 1, high - low), "suffix": part(high + 1, F.length("text") - high)})
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form was made of. A part holds no mark, so the marks tell where it ends."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    after = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(found: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
