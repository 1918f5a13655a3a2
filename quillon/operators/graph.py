"""Graph operators over edge tables (src, dst, relation): cycles, parallel edges and self-links are legal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut


def directed(edges: DataFrame, direction: str = "out", relations: Sequence[str] | None = None) -> DataFrame:
    """(here, there, relation) along, against or both ways; no relations at all if the list is empty."""
    if relations is not None:
        edges = edges.where(F.col("relation").isin(list(relations)) if relations else F.lit(False))
    out = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "relation")
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "relation")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def single_hop(edges: DataFrame, node, direction: str = "out", relations: Sequence[str] | None = None) -> DataFrame:
    return directed(edges, direction, relations).where(F.col("here") == node).select(F.col("there").alias("node"), "relation").distinct()


def distances(edges: DataFrame, starts: DataFrame, direction: str = "out", relations: Sequence[str] | None = None, max_hops: int | None = None) -> DataFrame:
    """node and hops: breadth-first distance from any of the starts (node), themselves at 0. If the starts have a column
    origin, the distances are those from each origin's starts, found in one walk.

    Each hop joins the frontier with the edges and drops nodes already visited; every step is a written table.
    """
    key = ["origin", "node"] if "origin" in starts.columns else ["node"]
    links = cut(directed(edges, direction, relations).select("here", "there").distinct().repartition("here"))
    frontier = cut(starts.select(*key).distinct().withColumn("hops", F.lit(0)))
    seen, hop = frontier, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = links.join(frontier, links["here"] == frontier["node"]).select(*key[:-1], F.col("there").alias("node")).distinct()
        frontier = cut(reached.join(seen, key, "left_anti").withColumn("hops", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier)) if hop % 8 == 0 else seen.unionByName(frontier)
    return seen


def traverse(edges: DataFrame, start, direction: str = "out", relations: Sequence[str] | None = None, max_hops: int | None = None) -> DataFrame:
    """Nodes reached from one start, without it."""
    kind = edges.schema["src"].dataType
    starts = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"))
    return distances(edges, starts, direction, relations, max_hops).where("hops > 0")


def common_ancestors(edges: DataFrame, a, b, relations: Sequence[str] | None = None) -> DataFrame:
    """Nodes from which both are reached with the least summed distance; ties stay. A node is its own ancestor."""
    kind = edges.schema["src"].dataType
    starts = edges.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(name).alias("origin"), F.lit(x).cast(kind).alias("node")) for name, x in (("a", a), ("b", b))))).alias("s")).select("s.*")
    up = distances(edges, starts, "in", relations).groupBy("node").agg(*(F.min(F.when(F.col("origin") == name, F.col("hops"))).alias(f"hops_{name}") for name in "ab"))
    both = cut(up.where("hops_a is not null and hops_b is not null").withColumn("hops", F.col("hops_a") + F.col("hops_b")))
    return both.join(F.broadcast(both.agg(F.min("hops").alias("_least"))), F.col("hops") == F.col("_least")).drop("_least")


def expand(edges: DataFrame, loaded: DataFrame, node, order: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """One-hop neighbourhood of a node: the first cap neighbours that are not loaded, by order (node, time, key), with
    nulls last; and one row with how many stay hidden."""
    new = single_hop(edges, node, "both").select("node").distinct().join(loaded.select("node"), "node", "left_anti").where(F.col("node") != node)
    ranked = new.join(order, "node", "left")
    shown = ranked.orderBy(F.col("time").asc_nulls_last(), F.col("key").asc_nulls_last(), "node").limit(cap)
    return shown, ranked.agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("hidden"))


def project_component(edges: DataFrame, origin, relations: Sequence[str] | None = None) -> DataFrame:
    """Undirected component of the origin over the chosen relations, origin included."""
    kind = edges.schema["src"].dataType
    return distances(edges, edges.sparkSession.range(1).select(F.lit(origin).cast(kind).alias("node")), "both", relations)


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def roots(edges: DataFrame) -> DataFrame:
    """Sources that nothing leads to."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def generations(edges: DataFrame, relations: Sequence[str] | None = None) -> DataFrame:
    """Shortest distance from the roots."""
    return distances(edges, roots(edges), "out", relations)


def longest_depth(edges: DataFrame) -> DataFrame:
    """Longest distance from the roots of an acyclic graph; rows still moving after as many rounds as nodes mean a cycle."""
    links = cut(edges.select("src", "dst").distinct().repartition("src"))
    nodes = links.select("src").union(links.select("dst")).distinct().count()
    frontier = depth = cut(roots(links).withColumn("depth", F.lit(0)))
    for n in range(1, nodes + 1):
        frontier = cut(links.join(frontier, links["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(n)))
        if not frontier.limit(1).count():
            return depth
        depth = cut(depth.unionByName(frontier).groupBy("node").agg(F.max("depth").alias("depth")))
    if nodes:
        raise ValueError("the graph has a cycle")
    return depth


def path_slice(edges: DataFrame, a, b, relations: Sequence[str] | None = None) -> DataFrame:
    """Nodes on some way from a to b: reached from a, and b is reached from them."""
    kind = edges.schema["src"].dataType
    one = lambda x: edges.sparkSession.range(1).select(F.lit(x).cast(kind).alias("node"))
    down = distances(edges, one(a), "out", relations).withColumnRenamed("hops", "from_a")
    up = distances(edges, one(b), "in", relations).withColumnRenamed("hops", "to_b")
    return down.join(up, "node")


def paths(edges: DataFrame, a, b, max_hops: int, relations: Sequence[str] | None = None) -> DataFrame:
    """path (array of nodes), hops of every simple way from a to b of at most max_hops edges.

    Only nodes on some way are followed, so that dead ends cost nothing; ways of a dense graph are as many as they are.
    """
    kind = edges.schema["src"].dataType
    on = cut(path_slice(edges, a, b, relations).select("node"))
    links = directed(edges, "out", relations).select("here", "there").distinct()
    links = cut(links.join(on.withColumnRenamed("node", "there"), "there", "left_semi").join(on.withColumnRenamed("node", "here"), "here", "left_semi"))
    ways = edges.sparkSession.range(1).select(F.array(F.lit(a).cast(kind)).alias("path"), F.lit(a).cast(kind).alias("here"))
    found = ways.where(F.lit(a == b))
    for _ in range(max_hops):
        ways = cut(ways.where(F.col("here") != F.lit(b)).join(links, "here").where(~F.array_contains("path", F.col("there"))).select(F.array_append("path", F.col("there")).alias("path"), F.col("there").alias("here")))
        if not ways.limit(1).count():
            break
        found = found.unionByName(ways.where(F.col("here") == F.lit(b)))
    return found.select("path", (F.size("path") - 1).alias("hops"))


def differing_siblings(edges: DataFrame, parameter: str) -> DataFrame:
    """src, children, pairs of children that were made with different parameters: counted by groups, no pairs are made.
    Edges have src, dst and the parameter."""
    kids = edges.groupBy("src", "dst").agg(F.min(parameter).alias("_p")).groupBy("src", "_p").agg(F.count("*").alias("_n"))
    both = kids.groupBy("src").agg(F.sum("_n").alias("children"), F.sum(F.col("_n") * F.col("_n")).alias("_same"))
    return both.select("src", "children", ((F.col("children") * F.col("children") - F.col("_same")) / 2).cast("long").alias("pairs")).where("pairs > 0")


def siblings(edges: DataFrame) -> DataFrame:
    """Pairs of different children of one parent: counted per parent, not listed."""
    kids = edges.groupBy("src").agg(F.count_distinct("dst").alias("children"))
    return kids.where("children > 1").select("src", "children", (F.col("children") * (F.col("children") - 1) / 2).cast("long").alias("pairs"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree of each node in the undirected graph of distinct edges, self-links left out."""
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return once.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def relationship_summary(edges: DataFrame, node, preview: int = 5) -> DataFrame:
    """For each relation: how many edges go out and come in, and the first few neighbours."""
    both = directed(edges, "out").withColumn("way", F.lit("out")).unionByName(directed(edges, "in").withColumn("way", F.lit("in"))).where(F.col("here") == node)
    first = F.array_join(F.slice(F.array_sort(F.collect_set("there")), 1, preview), ",")
    return both.groupBy("relation").agg(F.count_if(F.col("way") == "out").alias("n_out"), F.count_if(F.col("way") == "in").alias("n_in"), first.alias("preview"))


def integrity(versions: DataFrame, edges: DataFrame, version: str = "version_id") -> DataFrame:
    """Counts of violated graph rules: rule, violations."""
    ids = versions.select(F.col(version).alias("node"))
    incoming = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    checks = {
        "duplicate_id": ids.groupBy("node").count().where("count > 1"),
        "missing_source": edges.join(ids.withColumnRenamed("node", "src"), "src", "left_anti"),
        "missing_target": edges.join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti"),
        "several_parents": incoming.where("n > 1"),
        "self_link": edges.where("src = dst"),
        "duplicate_edge": edges.groupBy("src", "dst", "relation").count().where("count > 1"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out
