"""Groups of similarly named packages.

A name ``n`` is similar to ``p`` when ``p`` is a proper contiguous run of
``n``'s '_'-separated words (``p_...``, ``..._p_...``, ``..._p``). Instead of
a package x package LIKE join, every name is exploded into its proper word
runs (a handful per name) and equi-joined with the candidate names, so the
join is a plain shuffle/broadcast hash join on a string key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.graph import by_downloads, separation


def name_runs(packages: DataFrame) -> DataFrame:
    """``(name, run)`` for every proper contiguous run of the name's '_' words."""
    parts = F.split(F.col("name"), "_", -1)
    n = F.size(parts)
    starts = F.sequence(F.lit(1), n)
    spans = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(i, n), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    proper = F.filter(spans, lambda s: ~((s["i"] == 1) & (s["j"] == n)))
    runs = F.transform(proper, lambda s: F.array_join(F.slice(parts, s["i"], s["j"] - s["i"] + 1), "_"))
    return (packages.where(F.size(parts) > 1)
            .select("name", F.explode(F.array_distinct(runs)).alias("run")))


def similarly_named(packages: DataFrame, heads: DataFrame, min_downloads: float = 10) -> DataFrame:
    """``(package, similar_name, recent_downloads, pos)`` for each head package in ``heads(name)``;
    ``pos`` orders the names of a head by downloads."""
    cand = packages.where(F.col("recent_downloads") > min_downloads)
    runs = name_runs(cand)
    h = heads.select(F.col("name").alias("package"))
    j = runs.join(h, runs["run"] == h["package"])
    return (j.join(cand.select(F.col("name").alias("similar_name"), "recent_downloads"),
                   j["name"] == F.col("similar_name"))
            .where(F.col("similar_name") != F.col("package"))
            .select("package", "similar_name", "recent_downloads").distinct()
            .select("*", by_downloads(["package"], "similar_name")))


def similarly_named_connected(similar: DataFrame, edges: DataFrame, max_separation: int = 4,
                              require_reachable: bool = False, stdlib=None) -> DataFrame:
    """Similar names whose separation degree is < ``max_separation``
    (unreachable, -1, passes unless ``require_reachable``)."""
    pairs = similar.select(F.col("package").alias("a"), F.col("similar_name").alias("b")).distinct()
    sep = separation(edges, pairs, stdlib, max_separation - 1)
    ok = F.col("degree") < max_separation
    if require_reachable:
        ok = ok & (F.col("degree") >= 0)
    good = sep.where(ok).select(F.col("a").alias("package"), F.col("b").alias("similar_name"))
    return similar.join(good, ["package", "similar_name"], "left_semi")


def name_groups(packages: DataFrame, edges: DataFrame, head_min_downloads: float = 1000,
                min_downloads: float = 10, max_separation: int = 4, stdlib=None) -> DataFrame:
    """G10 + G11: ``(package, package_group)``. Each head (> ``head_min_downloads``)
    names a group of its similar packages; a package keeps the groups it is
    connected to that contain no other kept group name as a substring."""
    heads = packages.where(F.col("recent_downloads") > head_min_downloads).select("name")
    sim = similarly_named(packages, heads, min_downloads)
    mapping = sim.select(F.col("similar_name").alias("package"), F.col("package").alias("package_group"))
    pairs = mapping.select(F.col("package_group").alias("a"), F.col("package").alias("b")).distinct()
    sep = separation(edges, pairs, stdlib, max_separation - 1).where(F.col("degree") < max_separation)
    connected = mapping.join(sep, (mapping["package_group"] == sep["a"]) & (mapping["package"] == sep["b"]),
                             "left_semi")
    return group_dedup(connected)


def group_dedup(connected: DataFrame) -> DataFrame:
    """Drop a group when another kept group of the same package is a substring of it."""
    a, b = connected.alias("a"), connected.alias("b")
    contains = (a.join(b, (F.col("a.package") == F.col("b.package"))
                       & (F.col("a.package_group") != F.col("b.package_group"))
                       & F.col("a.package_group").contains(F.col("b.package_group")))
                .select(F.col("a.package").alias("package"), F.col("a.package_group").alias("package_group")))
    return connected.join(contains, ["package", "package_group"], "left_anti").distinct()


def group_members(groups: DataFrame, names: DataFrame) -> DataFrame:
    """For each ``names(name)``: members of the group it names, or when it
    names no group, the distinct members of all groups it belongs to."""
    n = names.select(F.col("name")).distinct()
    own = (n.join(groups, n["name"] == groups["package_group"])
           .select("name", F.col("package").alias("member")))
    has_own = own.select("name").distinct()
    theirs = (n.join(has_own, "name", "left_anti")
              .join(groups.select(F.col("package").alias("name"), "package_group"), "name")
              .join(groups.select(F.col("package_group"), F.col("package").alias("member")), "package_group")
              .select("name", "member"))
    return own.unionByName(theirs).distinct()


def group_classes(groups: DataFrame, packages: DataFrame) -> DataFrame:
    """G13 as classes: ``(package_group, package, recent_downloads, pos, n_members)``, a row a member and not a row a pair:
    its downloads, its place in the group by these, and the number of members with downloads."""
    rows = groups.select("package_group", "package").distinct().join(
        packages.select(F.col("name").alias("package"), "recent_downloads"), "package")
    members = F.count(F.lit(1)).over(Window.partitionBy("package_group")).alias("n_members")
    return rows.select("package_group", "package", "recent_downloads", by_downloads(["package_group"], "package"), members)


def group_siblings(groups: DataFrame, packages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Packages sharing a group with each of ``names(name)`` (all, if none are given), with their downloads and, by these,
    their order. ``group_classes`` has the same without a row a pair."""
    g = groups.select(F.col("package").alias("name"), "package_group")
    if names is not None:
        g = g.join(names.select("name").distinct(), "name", "left_semi")
    classes = group_classes(groups, packages).select("package_group", F.col("package").alias("sibling"), "recent_downloads")
    return (g.join(classes, "package_group").select("name", "sibling", "recent_downloads").distinct()
            .select("*", by_downloads(["name"], "sibling")))
