"""A depth-first walk over variants of a query, under budgets and with a reserve for verification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import fixed, searches
from provena.operators.iterate import dealt, written


@dataclass(frozen=True)
class Budget:
    """Expansions and fetches of one walk; of the fetches ``lenses`` times ``leaves`` are held back for verification."""

    expansions: int = 25
    fetches: int = 45
    lenses: tuple[str, ...] = fixed.WALK_LENSES
    leaves: int = 5

    @property
    def discovery(self) -> int:
        return max(0, self.fetches - min(self.fetches, len(self.lenses) * self.leaves))


def trajectories(query: Column) -> Column:
    """Array of (category, text): a variant of the query for each category, the query itself where it has none."""
    def of(found: Column, category: str) -> Column:
        if category == "sea_local_language":
            return F.concat(query, F.lit(" " + fixed.WALK_LOCAL))
        kinds = [k for k, c in fixed.WALK_CATEGORY_OF.items() if c == category]
        return F.coalesce(F.get(F.transform(F.filter(found, lambda v: v["kind"].isin(*kinds)), lambda v: v["text"]), 0), query)

    # The variants are worked out once for all categories.
    all_ = lambda found: F.array(*(F.struct(F.lit(c).alias("category"), of(found, c).alias("text")) for c in fixed.WALK_CATEGORIES))
    return F.element_at(F.transform(F.array(searches.variants(query)), all_), 1)


def _short(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(12))


def walk(roots: DataFrame, budget: Budget = Budget(), width: int = 5, depth: int = 3, spread: Callable[[Column], Column] = trajectories, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, leaves) of the walks from ``roots`` (root, query).

    A node has ``width`` children; of siblings the last is visited first. The place of a node among all that could be
    expanded, in the order of visits, follows from its path: it is the parent's place, one, and the whole subtrees of the
    siblings visited before. The budget is a running sum over these places: a node is expanded while its place is within
    the expansions and a fetch is left for a child, and the last one may have fewer children. So a level of the tree is
    one step for all walks at once, and what is not expanded is never made.

    edges: root, parent, child, depth, query, category, confidence (0.85 a hop). leaves: root, place, node, query, depth,
    verified, verdicts, agree; leaves are verified in the order of visits while a fetch is left for every lens.
    ``verdicts`` (query, lens, verdict) is what the lenses say; without a row a lens says "active".
    """
    if depth < 1:
        raise ValueError("a walk has a depth of one at least")
    # Nodes that a subtree could expand, by the depth of its root.
    inner = [sum(width**i for i in range(depth - d)) for d in range(depth)] + [0]
    level = dealt(roots).select("root", F.col("query"), _short(F.col("query")).alias("node"), F.lit(0).alias("depth"), F.lit(1).alias("place"), F.array().cast("array<int>").alias("path"))
    edges, ends = None, None
    for d in range(depth + 1):
        spent = (F.col("place") - 1) * width
        open_ = (F.col("place") <= budget.expansions) & (spent + 1 <= budget.discovery) if d < depth else F.lit(False)
        end = level.where(~open_).select("root", "path", "node", "query", "depth")
        ends = end if ends is None else ends.unionByName(end)
        if d == depth:
            break
        kids = F.slice(spread(F.col("query")), F.lit(1), F.least(F.lit(width), budget.discovery - spent))
        grown = level.where(open_).select("root", F.col("node").alias("parent"), "place", "path", F.posexplode(kids).alias("i", "kid"))
        child = _short(F.concat(F.col("parent"), F.lit(f":{d + 1}:"), F.col("kid.text")))
        # Written, so that edges, leaves and the next level don't work out the variants again.
        grown = written(grown.select("root", "parent", "place", "path", "i", F.col("kid.text").alias("query"), F.col("kid.category").alias("category"), child.alias("child")), "grown")
        edge = grown.select("root", "parent", "child", F.lit(d + 1).alias("depth"), "query", "category", F.lit(round(0.85 ** (d + 1), 4)).alias("confidence"))
        edges = edge if edges is None else edges.unionByName(edge)
        before = (width - 1 - F.col("i")) * inner[d + 1]
        level = grown.select("root", "query", F.col("child").alias("node"), F.lit(d + 1).alias("depth"), (F.col("place") + 1 + before).alias("place"), F.concat("path", F.array((width - F.col("i")).cast("int"))).alias("path"))
    used = edges.groupBy("root").agg(F.count("*").alias("_used"))
    order = Window.partitionBy("root").orderBy("path")
    leaves = ends.withColumn("place", F.row_number().over(order)).join(used, "root", "left")
    left = budget.fetches - F.coalesce("_used", F.lit(0))
    leaves = leaves.select("root", "place", "node", "query", "depth", (F.col("place") <= F.floor(left / len(budget.lenses))).alias("verified"))
    if verdicts is not None:
        said = verdicts.groupBy("query").agg(F.map_from_entries(F.collect_set(F.struct("lens", "verdict"))).alias("_said"))
        leaves = leaves.join(said, "query", "left")
    else:
        leaves = leaves.withColumn("_said", F.lit(None).cast("map<string,string>"))
    told = F.array(*(F.coalesce(F.try_element_at("_said", F.lit(x)), F.lit("active")) for x in budget.lenses))
    leaves = leaves.withColumn("verdicts", F.when(F.col("verified"), told)).withColumn("agree", F.size(F.array_distinct("verdicts")) == 1)
    return edges, leaves.select("root", "place", "node", "query", "depth", "verified", "verdicts", F.when(F.col("verified"), F.col("agree")).alias("agree"))
