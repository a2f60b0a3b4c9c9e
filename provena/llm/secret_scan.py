"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Base matches (assign, access, hex) and other long mixed tokens (generic) are candidates. Their hashes are counted over
the whole corpus by distinct repository and owner, in two aggregations that both combine before the shuffle, so that
one much-copied string is no hot group. A candidate that more than ``owners`` owners hold, or one of them in more than
``repos`` of its repositories, is a widely copied example; any other is owner-specific and looks live. Generic
candidates are added only where they are live and overlap no base span; base spans stay.

Null text is empty text: no spans. Null owners count as one owner, null repositories as one repository. Rows are told
apart by position, so repeated rows keep a result each. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import written
from provena.llm.native import by_start, count_of, joined, overlapped, spans

KINDS = ("assign", "access", "hex", "generic")
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGNED = r"""^(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f](?<![0-9a-f]{2})[0-9a-f]{23,}+"
GENERIC = r"[A-Za-z0-9+/_=-](?<![A-Za-z0-9+/_=-]{2})[A-Za-z0-9+/_=-]{19,}+"
#: More owners, or repositories of one owner, than this make a candidate a widely copied example.
OWNERS, REPOS = 2, 25
BITS = 20
_ITEM = "struct<k:int,kind:string,s:int,e:int,h:bigint>"


def _items(k: int, found: Column, value=lambda x: x["v"]) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(k).alias("k"), F.lit(KINDS[k]).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.xxhash64(value(x)).alias("h")).cast(_ITEM))


def candidates(text: Column) -> Column:
    """Array of (k, kind, s, e, h): base spans, then generic ones, overlapping or not; h is the secret's hash."""
    none = F.array().cast(f"array<{_ITEM}>")
    value = lambda x: F.regexp_extract(x["v"], ASSIGNED, 1)
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), _items(0, F.filter(spans(text, ASSIGN), lambda x: F.length(value(x)) >= 6), value)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _items(1, spans(text, ACCESS))).otherwise(none)
    mixed = lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]")
    generic = F.when(text.rlike("[0-9]"), _items(3, F.filter(spans(text, GENERIC), mixed))).otherwise(none)
    return F.concat(assign, access, _items(2, spans(text, HEX)), generic)


def ownership(at: DataFrame) -> DataFrame:
    """(h, n_owners, n_repos, most_repos) from (h, owner, repo): distinct repositories by owner first, then owners."""
    each = at.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    each = each.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    return each.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("repos").alias("most_repos"))


def find(docs: DataFrame, owner: str = "source", repo: str = "doc_id", owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """Per document (doc_id, text_hash, base, live, examples): arrays of (k, kind, s, e)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), text.alias("text"))
    table = table.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", F.xxhash64("text").alias("text_hash"), candidates(F.col("text")).alias("items"))
    table = written(table, "candidates")
    at = table.where(F.size("items") > 0).select("rid", "owner", "repo", F.explode("items").alias("x")).select("rid", "owner", "repo", "x.*")
    at = written(at.withColumn("over", overlapped(F.col("k") < 3)).where((F.col("k") < 3) | F.col("over").isNull()).drop("over"), "spans")
    live = (F.col("n_owners") <= owners) & (F.col("most_repos") <= repos)
    at = at.join(written(ownership(at), "ownership"), "h").select("rid", F.struct("k", "kind", "s", "e").alias("x"), live.alias("live"))
    judged = at.groupBy("rid").agg(F.collect_list(F.when(F.col("live"), F.col("x"))).alias("live"), F.collect_list(F.when(~F.col("live"), F.col("x"))).alias("examples"))
    none = F.array().cast("array<struct<k:int,kind:string,s:int,e:int>>")
    plain = F.transform(F.filter("items", lambda x: x["k"] < 3), lambda x: F.struct(x["k"].alias("k"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return table.join(judged, "rid", "left").select("doc_id", "text_hash", plain.alias("base"), F.coalesce("live", none).alias("live"), F.coalesce("examples", none).alias("examples"))


def digest(found: DataFrame) -> DataFrame:
    counts = (count_of(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3))
    added = F.filter("live", lambda x: x["k"] == 3)
    return found.select("doc_id", *counts, F.sha2(joined(by_start(F.col("base"))), 256).alias("base_sha256"), joined(by_start(F.concat(F.col("base"), added))).alias("spans"), F.size("live").cast("long").alias("n_live"), F.size("examples").cast("long").alias("n_examples"))


def redact(docs: DataFrame, mark: str = "[secret]", **how) -> DataFrame:
    """``docs`` with every live secret in ``text`` replaced by ``mark``; columns and rows stay.

    Secrets that overlap are replaced as one. A broadcast of at most 2^20 small numbers, from the hashes of the texts
    that hold a live secret, tells the others apart where they are read; only the rest are joined, on doc_id and hash.
    """
    found = find(docs, **how).where(F.size("live") > 0).groupBy("doc_id", "text_hash").agg(F.first("live").alias("_provena_live"))
    found = written(found, "live").withColumnsRenamed({"doc_id": "_provena_id", "text_hash": "_provena_hash"})
    text = F.col("text").cast("string")
    bits = F.broadcast(found.select(F.pmod("_provena_hash", F.lit(1 << BITS)).alias("_provena_bit")).distinct())
    docs_bit = docs.withColumn("_provena_hash_of", F.xxhash64(F.coalesce(text, F.lit("")))).withColumn("_provena_bit", F.pmod("_provena_hash_of", F.lit(1 << BITS)))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(F.lit(0), x["s"] - a["at"]))
        piece = F.when(x["s"] >= a["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))

    end = F.lit(2**31 - 1)
    cut = F.aggregate(by_start(F.col("_provena_live")), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, end)))
    maybe = docs_bit.join(bits, "_provena_bit", "left_semi").join(found, F.col("doc_id").eqNullSafe(F.col("_provena_id")) & (F.col("_provena_hash_of") == F.col("_provena_hash")), "left")
    changed = maybe.withColumn("text", F.when(F.col("_provena_live").isNotNull(), cut).otherwise(text)).select(*docs.columns)
    return docs_bit.join(bits, "_provena_bit", "left_anti").select(*docs.columns).unionByName(changed)
