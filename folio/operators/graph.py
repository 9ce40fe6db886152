"""Package dependency graph as DataFrames.

Graph walks are level-by-level joins of a frontier with the edge table. All
walks are multi-source: one job answers many start packages, breadth-first walks
with the starts of a node as bits. Levels are few (the reference walks at most
3-4 steps); lineage is cut with a reliable checkpoint every level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.components import components
from folio.operators.ends import distances, stored
from folio.operators.frontiers import bits_of, meetings, numbered, starts_of, walk
from folio.session import cut_lineage, mounted_folder, written

# Per-degree download floors used to keep neighbours (degree 0..4).
DEGREE_FLOORS = {0: 1, 1: 100, 2: 15_000, 3: 1_000_000, 4: 3_000_000}
# Standard-library packages that are one step from everything.
STDLIB = ["ex_unit", "logger", "eex"]
# The pruned walk threshold to step into distance k is
# base * growth**(k-1) (10,000, 100,000, 1,000,000 for k = 1, 2, 3).
WALK_BASE, WALK_GROWTH, WALK_MAX_DISTANCE = 10_000, 10, 3


def edges_min_downloads(edges: DataFrame, packages: DataFrame, min_downloads: float) -> DataFrame:
    """Edges whose two ends both have >= ``min_downloads``."""
    ok = packages.where(F.col("recent_downloads") >= min_downloads).select(F.col("name"))
    return (edges.join(ok.withColumnRenamed("name", "source"), "source", "left_semi")
            .join(ok.withColumnRenamed("name", "target"), "target", "left_semi")
            .select("source", "target").distinct())


def edges_all(edges: DataFrame) -> DataFrame:
    """All edges, de-duplicated."""
    return edges.select("source", "target").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, as ``(src, dst)``."""
    fwd = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return fwd.unionByName(back).distinct()


def bfs(edges: DataFrame, starts: DataFrame, max_degree: int | None, directed: bool = False) -> DataFrame:
    """Breadth-first neighbours ``(start, package, degree)``, first-seen degree, the start itself at degree 0, by
    bit-parallel frontiers (``folio.operators.frontiers``). ``max_degree=None`` walks to exhaustion."""
    adj = cut_lineage(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
                      if directed else undirected(edges))
    numbers = cut_lineage(numbered(starts.select("start").distinct(), "number"))
    levels = [level.withColumn("degree", F.lit(k).cast("bigint"))
              for k, level in enumerate(walk(adj, numbers, max_degree, both_ways=not directed))]
    return starts_of(reduce(DataFrame.unionByName, levels), numbers)


def neighbours_by_degree(neighbours: DataFrame, size: int = 1000) -> DataFrame:
    """K4: ``(start, degree, part, packages)``: the sorted packages of a (start, degree) in lists of at most ``size``,
    ``part`` from 0, so that a hub makes more rows and not a longer list."""
    place = F.row_number().over(Window.partitionBy("start", "degree").orderBy("package")) - 1
    parts = neighbours.withColumn("part", F.floor(place / size))
    return parts.groupBy("start", "degree", "part").agg(F.array_sort(F.collect_list("package")).alias("packages"))


def pruned_walk(edges: DataFrame, packages: DataFrame, starts: DataFrame,
                base: float = WALK_BASE, growth: float = WALK_GROWTH,
                max_distance: int = WALK_MAX_DISTANCE) -> DataFrame:
    """Directed walk where stepping into distance k needs downloads >
    ``base * growth**(k-1)``; rows ``(start, target, recent_downloads, distance)``
    de-duplicated (set semantics, a node may appear at several distances)."""
    e = edges.select("source", "target").distinct()
    p = packages.select(F.col("name").alias("target"), "recent_downloads")
    levels = []
    cur = starts.select("start", F.col("start").alias("node"))
    for k in range(1, max_distance + 1):
        floor = float(base) * float(growth) ** (k - 1)
        nxt = (cur.join(e, cur["node"] == e["source"])
               .join(p, "target")
               .where(F.col("recent_downloads") > F.lit(floor))
               .select("start", "target", "recent_downloads", F.lit(k).cast("bigint").alias("distance"))
               .distinct())
        levels.append(nxt)
        cur = nxt.select("start", F.col("target").alias("node")).distinct()
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def nearest_distance(walk: DataFrame) -> DataFrame:
    """Per (start, package) the smallest distance and downloads."""
    return walk.groupBy("start", F.col("target").alias("package")).agg(
        F.min("distance").alias("distance"), F.min("recent_downloads").alias("recent_downloads"))


def by_downloads(group: list[str], name: str) -> Column:
    """Place within the group, most downloads first, ties by name."""
    w = Window.partitionBy(*group).orderBy(F.desc("recent_downloads"), name)
    return F.row_number().over(w).cast("bigint").alias("pos")


def degree_floor(neighbours: DataFrame, packages: DataFrame, floors: dict[int, float] | None = None
                 ) -> DataFrame:
    """Neighbours whose downloads exceed the floor of their degree, numbered within (start, degree) from
    the most downloaded (``pos``, ties by name)."""
    floors = floors or DEGREE_FLOORS
    spark = neighbours.sparkSession
    ft = spark.createDataFrame([(int(k), float(v)) for k, v in floors.items()], "degree bigint, floor double")
    return (neighbours.join(F.broadcast(ft), "degree")
            .join(packages.withColumnRenamed("name", "package"), "package")
            .where(F.col("recent_downloads") > F.col("floor"))
            .select("start", "degree", "package", "recent_downloads", by_downloads(["start", "degree"], "package")))


def separation(edges: DataFrame, pairs: DataFrame, stdlib: list[str] | None = None,
               max_levels: int | None = None) -> DataFrame:
    """Degree of separation for ``pairs(a, b)``: 1 when either is a standard
    package, 0 for itself, the undirected BFS distance, or -1 when unreachable.

    Component labels settle the unreachable pairs at once. The others are settled where walks from both their ends meet, half the way
    from each: within tasks that map the graph's files (``ends.distances``), or, where the shared folder is not mounted, by bit-parallel
    fronts as tables (``frontiers.meetings``). With ``max_levels``, what is farther gets ``max_levels + 1``.
    """
    stdlib = STDLIB if stdlib is None else stdlib
    adj = written(undirected(edges))
    nodes = cut_lineage(numbered(adj.select(F.col("src").alias("node")).where("node is not null").distinct()
                                 .repartitionByRange("node").sortWithinPartitions("node"), "place"))
    at = lambda node, place: nodes.select(F.col("node").alias(node), F.col("place").alias(place))
    links = written(adj.join(at("src", "u"), "src").join(at("dst", "v"), "dst").select("u", "v"))
    labels = cut_lineage(component_labels(nodes, links))
    pairs = pairs.select("a", "b").distinct()
    std = F.col("a").isin(stdlib) | F.col("b").isin(stdlib) if stdlib else F.lit(False)
    of = lambda end: labels.toDF(end, f"{end}_place", f"{end}_label")
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    known = cut_lineage(known.select("a", "b", F.col("a_place").alias("u"), F.col("b_place").alias("v"), "a_label", F.when(std, 1).when(
        F.col("a") == F.col("b"), 0).when(F.col("a_label").isNull() | F.col("b_label").isNull() | (F.col("a_label") != F.col("b_label")), -1)
        .cast("bigint").alias("degree")))
    found = known.where(F.col("degree").isNotNull()).select("a", "b", "degree")
    left = known.where(F.col("degree").isNull()).drop("degree")
    far = F.lit(-1 if max_levels is None else max_levels + 1).cast("bigint")
    folder = mounted_folder(edges.sparkSession, "graph")
    if left.isEmpty():
        return found
    if folder:
        left = written(distances(stored(links, nodes.count(), folder), left.select("a", "b", "u", "v"), max_levels))
        return found.unionByName(left.select("a", "b", F.when(F.col("degree") < 0, far).otherwise(F.col("degree")).alias("degree")))
    # Pairs of a component, and of a start, are near in number: what their walks share is in the same words.
    left = cut_lineage(numbered(left.repartitionByRange("a_label", "a").sortWithinPartitions("a_label", "a"), "number"))
    met = [words.withColumn("degree", F.lit(degree).cast("bigint")) for degree, words in meetings(
        links.toDF("src", "dst"), left.select(F.col("u").alias("a"), F.col("v").alias("b"), "number"), max_levels)]
    if met:
        left = left.join(bits_of(reduce(DataFrame.unionByName, met), "met"), "number", "left")
    else:
        left = left.withColumn("degree", far)
    return found.unionByName(left.select("a", "b", F.coalesce("degree", far).alias("degree")))


def component_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, place, label)`` for ``nodes(node, place)`` and ``links(u, v)`` of places, both directions given: nodes with one label
    reach each other."""
    found = components(links).select(F.col("node").alias("place"), "component")
    return nodes.join(found, "place", "left").select("node", "place", F.coalesce("component", "place").alias("label"))
