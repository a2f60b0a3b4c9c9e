"""Duplicates: the best row of a key, and greedy first-wins removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import text as T
from provena.functions.similar import within


def best_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``; keys may be null."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def candidate_key(website: str, vendor: str) -> Column:
    """The registrable domain, or else the lower-cased name."""
    domain = T.registrable(F.col(website))
    return F.when(F.coalesce(F.col(website), F.lit("")) != "", F.concat(F.lit("d:"), domain)).otherwise(F.concat(F.lit("n:"), F.lower(vendor)))


def candidates(df: DataFrame, by: list[str], refs: str, seq: str) -> DataFrame:
    """Of candidates of one key the one with most evidence, the earliest on ties."""
    return best_of(df.withColumn("key", candidate_key("website", "vendor_name")), [*by, "key"], [F.desc(refs), F.asc(seq)])


def _without(rows: DataFrame, keys: DataFrame, by: list[str], key: str) -> DataFrame:
    """``rows`` whose ``key`` is none of ``keys`` (by, key); a null key is none."""
    return rows.join(keys.select(*by, key).where(F.col(key).isNotNull()).distinct(), [*by, key], "left_anti")


def _ordered(rows: DataFrame, seq: str) -> DataFrame:
    if not rows.where(F.col(seq).isNull()).isEmpty():
        raise ValueError(f"rows whose {seq} is null cannot be decided")
    return rows


def first_items(df: DataFrame, by: list[str], keys: list[str], seq: str, similar: DataFrame | None = None, snippet: str | None = None) -> DataFrame:
    """Greedy in the order of ``seq``: a row goes if a kept earlier row shares one of its ``keys`` or has a like ``snippet``.

    ``similar`` (by, snippet, kept): a row of the first snippet goes for a kept earlier one of the second. A dropped row
    counts for nothing. These rows are the first maximal independent set of the graph of shared keys and likeness: a row
    stays once no earlier open row shares a key or is like it, and all rows that it excludes go. Rounds repeat over
    what is still open and decide at least the first open row of each ``by``, so a chain of rows takes as many rounds
    as it is long. Null keys and null snippets exclude nothing. A row without ``seq`` has no place in the order and is
    an error; of rows equal in ``by`` and ``seq`` all are first at once.
    """
    from provena.operators.iterate import written

    opened = _ordered(written(df, "open"), seq)
    kept = None
    while not opened.isEmpty():
        ready = opened
        for k in keys:
            # Rows that are the least of their key: found by equality with it, so that no key is gathered in one task.
            least = opened.where(F.col(k).isNotNull()).groupBy(*by, k).agg(F.min(seq).alias(seq))
            ready = ready.where(F.col(k).isNull()).unionByName(ready.join(least, [*by, k, seq], "left_semi").select(ready.columns))
        if similar is not None:
            least = opened.where(F.col(snippet).isNotNull()).groupBy(*by, F.col(snippet).alias("kept")).agg(F.min(seq).alias("_least"))
            behind = similar.join(least, [*by, "kept"]).groupBy(*by, snippet).agg(F.min("_least").alias("_least"))
            ready = ready.join(behind, [*by, snippet], "left").where(F.col("_least").isNull() | (F.col("_least") >= F.col(seq))).select(opened.columns)
        ready = written(ready, "kept")
        kept = ready if kept is None else kept.unionByName(ready)
        rest = opened.join(ready.select(*by, seq).distinct(), [*by, seq], "left_anti")
        for k in keys:
            rest = _without(rest, ready, by, k)
        if similar is not None:
            gone = similar.join(ready.groupBy(*by, F.col(snippet).alias("kept")).agg(F.min(seq).alias("_least")), [*by, "kept"]).groupBy(*by, snippet).agg(F.min("_least").alias("_least"))
            rest = rest.join(gone, [*by, snippet], "left").where(F.col("_least").isNull() | (F.col("_least") > F.col(seq)))
        opened = written(rest.select(df.columns), "open")
    return kept if kept is not None else opened


def exact_items(df: DataFrame, by: list[str], keys: list[str], seq: str) -> DataFrame:
    """``first_items`` by keys alone."""
    return first_items(df, by, keys, seq)


#: Characters of a gram; a matched ratio of 0.92 leaves at least 0.3 of both lengths, less 2, of them in common.
GRAM, RATIO = 3, 0.92


def _near():
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def near(new, kept):
        import pandas as pd

        from provena.functions.similar import at_least

        return pd.Series([at_least(x, y, RATIO) for x, y in zip(new, kept, strict=True)], dtype="bool")

    return near


def like(texts: DataFrame, by: list[str], name: str, text: str) -> DataFrame:
    """(by, name, kept): pairs of distinct ``texts`` (by, name, text) of which the first, new, is near the second: at least
    RATIO by the matching blocks of difflib.

    Of a text of l characters with m matched ones, each unmatched one spoils at most GRAM of its grams and each of the
    other's GRAM - 1, so that at least 0.3 (l + l') - 2 grams are shared, and one of them is among the first
    0.4445 l + 1 grams of either in the order of rareness within ``by``. Only texts that share such a one, and whose
    lengths allow the ratio, are compared; texts without another of like length do not come so far. Empty texts are near
    none, and texts under six characters only their equals.
    """
    from provena.operators.iterate import written

    fits = lambda a, b: 2 * F.least(a, b) >= RATIO * (a + b) - 1e-9
    sized = texts.where(F.length(text) >= 2 * GRAM).select(*by, name, text, F.length(text).alias("_l")).dropDuplicates([*by, name])
    # Lengths of a run in order: a text's nearest other lengths tell whether any other can be near it.
    lengths = sized.groupBy(*by, "_l").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy("_l")
    beside = [F.coalesce(fits(F.col("_l"), f("_l").over(order)), F.lit(False)) for f in (F.lag, F.lead)]
    sized = written(sized.join(lengths.withColumn("_ok", (F.col("_n") > 1) | beside[0] | beside[1]).where("_ok").select(*by, "_l"), [*by, "_l"]), "sized")
    # Grams with the number of their occurrence, so that a repeated one counts as often as it stands there.
    grams = F.transform(F.sequence(F.lit(1), F.col("_l") - (GRAM - 1)), lambda i: F.substring(F.col(text), i, F.lit(GRAM)))
    rows = sized.select(*by, name, "_l", F.explode(grams).alias("_g")).groupBy(*by, name, "_l", "_g").agg(F.count("*").alias("_c"))
    rows = written(rows.select(*by, name, "_l", F.explode(F.sequence(F.lit(1), F.col("_c").cast("int"))).alias("_o"), "_g").select(*by, name, "_l", F.xxhash64("_g", "_o").alias("_t")), "grams")
    often = rows.groupBy(*by, "_t").agg(F.count("*").alias("_df")).where("_df > 1")
    # A gram of one text alone finds nothing, but it takes its place in the order: it is rarer than all others.
    rare = Window.partitionBy(*by, name).orderBy(F.coalesce("_df", F.lit(1)), "_t")
    placed = rows.join(often, [*by, "_t"], "left").withColumn("_p", F.row_number().over(rare))
    prefix = written(placed.where((F.col("_p") <= F.floor(0.4445 * F.col("_l") + 1)) & F.col("_df").isNotNull()).select(*by, name, "_l", "_t"), "prefix")
    other = prefix.select(*by, F.col(name).alias("kept"), F.col("_l").alias("_l2"), "_t")
    pairs = prefix.join(other, [*by, "_t"]).where((F.col(name) < F.col("kept")) & fits(F.col("_l"), F.col("_l2"))).select(*by, name, "kept").distinct()
    both = pairs.join(sized.select(*by, name, F.col(text).alias("_a")), [*by, name]).join(sized.select(*by, F.col(name).alias("kept"), F.col(text).alias("_b")), [*by, "kept"])
    both = both.where(within(F.col("_a"), F.col("_b"), RATIO))
    near = _near()
    told = written(both.select(*by, name, "kept", near("_a", "_b").alias("_x"), near("_b", "_a").alias("_y")), "told")
    turned = told.where("_y").select(*by, F.col("kept").alias(name), F.col(name).alias("kept"))
    return told.where("_x").select(*by, name, "kept").unionByName(turned)


#: Rows of a run that are settled at once, and the share of all open rows that must go with such blocks for others to follow.
BLOCK, SHARE = 128, 0.1


def _blocks(opened: DataFrame, by: list[str], keys: list[str], seq: str, snippet: str) -> DataFrame:
    """The first rows of each run, BLOCK at most, with ``_stays``; rows that are equal in ``seq`` are never parted."""
    import pyarrow as pa
    from pyspark.sql import types

    order = Window.partitionBy(*by).orderBy(seq)
    head = opened.withColumns({"_n": F.row_number().over(order), "_r": F.rank().over(order)}).where(F.col("_n") <= BLOCK + 1)
    names = opened.columns

    def settle(table):
        from provena.functions.similar import at_least

        table = table.sort_by("_n")
        ranks = table.column("_r").to_pylist()
        n = len(ranks) if len(ranks) <= BLOCK else ranks.index(ranks[-1])
        values = list(zip(*(table.column(k).to_pylist() for k in (*keys, snippet)), strict=True))
        seen, texts, new, stays = [set() for _ in keys], [], [], []
        for i in range(n):
            if i and ranks[i] != ranks[i - 1]:
                # What stays counts for later rows only.
                for own in new:
                    for s, k in zip(seen, own, strict=False):
                        s.add(k)
                    texts.append(own[-1])
                new = []
            *own, text = values[i]
            free = not any(k is not None and k in s for s, k in zip(seen, own, strict=True)) and not any(at_least(text, t, RATIO) for t in texts)
            stays.append(free)
            if free:
                new.append(values[i])
        return table.select(names).slice(0, n).append_column("_stays", pa.array(stays, pa.bool_()))

    return head.groupBy(*by).applyInArrow(settle, types.StructType([*opened.schema.fields, types.StructField("_stays", types.BooleanType())]))


def _settled(opened: DataFrame, by: list[str], keys: list[str], seq: str, name: str, snippet: str) -> tuple[list[DataFrame], DataFrame]:
    """(tables of rows that stay, rows still open): the first rows of each run are settled in order, and what they exclude
    goes at once, for as long as that is much. A row meets those that stay alone, so that the cost grows with the rows."""
    from provena.operators.iterate import dealt, side, written

    kept, near, n = [], _near(), opened.count()
    while n:
        block = written(_blocks(opened, by, keys, seq, snippet), "block")
        stays = block.where("_stays").select(opened.columns)
        kept.append(stays)
        last = block.groupBy(*by).agg(F.max(seq).alias("_last"))
        rest = opened.join(side(last), by, "left").where(F.col("_last").isNull() | (F.col(seq) > F.col("_last"))).drop("_last")
        for k in keys:
            rest = rest.join(side(stays.where(F.col(k).isNotNull()).select(*by, k).distinct()), [*by, k], "left_anti")
        rest = written(rest.select(opened.columns), "rest")
        texts = dealt(rest.where(F.length(snippet) > 0).select(*by, name, snippet).dropDuplicates([*by, name]))
        held = side(stays.where(F.length(snippet) > 0).select(*by, F.col(snippet).alias("_kept")))
        gone = texts.join(held, by).where(within(F.col(snippet), F.col("_kept"), RATIO)).where(near(snippet, "_kept"))
        gone = written(gone.select(*by, name).distinct(), "gone")
        opened = written(rest.join(side(gone), [*by, name], "left_anti").select(opened.columns), "open")
        before, n = n, opened.count()
        if before - n < SHARE * before:
            break
    return kept, opened


def items(df: DataFrame, by: list[str], keys: list[str], seq: str, snippet: str) -> DataFrame:
    """Greedy removal by ``keys`` and by near-duplicate snippets, the first row of each stays.

    Runs whose rows are much alike are settled in blocks against the rows that stay; of what is then left, rows that are
    little alike, pairs are found by ``like`` and settled in rounds.
    """
    from provena.operators.iterate import written

    name = F.when(F.length(snippet) > 0, F.md5(F.col(snippet).cast("binary")))
    rows = _ordered(written(df.withColumn("_snippet", name), "items"), seq)
    # Equal snippets are near each other, too.
    keys = [*keys, "_snippet"]
    kept, rest = _settled(rows, by, keys, seq, "_snippet", snippet)
    if not rest.isEmpty():
        pairs = written(like(rest.where(F.col("_snippet").isNotNull()).select(*by, "_snippet", snippet).distinct(), by, "_snippet", snippet), "like")
        kept.append(first_items(rest, by, keys, seq, pairs, "_snippet"))
    return reduce(DataFrame.unionByName, kept, rows.limit(0)).drop("_snippet")
