"""Driver queries for the package graph, name groups, BM25 and blends.

Download thresholds are parameters; the defaults in the operators are the
reference values, while these queries pass values scaled to the test data
(part downloads are 20..1400, documentation packages 85k..155k at sf0.01).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import graph as G
from folio.operators import rank as RK
from folio.operators import requests as R
from folio.operators import similar as S
from folio.plans import oracle as O
from folio.plans.registry import register
from folio.session import cut_lineage
from folio.sources import testdata as D

with_sql = D.with_sql

# Part graph parameters (scaled).
EDGE_MIN = 800
WALK = dict(base=500.0, growth=1.25, max_distance=3)
FLOORS = {0: 1, 1: 700, 2: 900}
# Name groups (scaled).
HEAD_MIN, SIMILAR_MIN = 20, 2
# Documentation-package blends (scaled).
DOC_WALK = dict(base=100_000.0, growth=1.2, max_distance=3)
BLEND_FLOOR = 100_000
BLEND_REQUESTS = [(1, "the", "src0"), (2, "ent", "src5"), (3, "ion", "src10"), (4, "aux +ent", "src3"),
                  (5, "mix -tasks", "src7"), (6, "ein", "src12")]
BM25_REQUESTS = [(1, "the of", None), (2, "+and +the", None), (3, "de la -the", None),
                 (4, "title:mix", None), (5, "the_of", None), (6, "th*", None)]


def _nodes(edges):
    return edges.select(F.col("source").alias("start")).union(
        edges.select(F.col("target").alias("start"))).distinct()


NODES_SQL = """
und AS (SELECT source AS src, target AS dst FROM edges UNION SELECT target, source FROM edges),
nodes AS (SELECT src AS start FROM und UNION SELECT dst FROM und)"""


# ------------------------------------------------------------------ G1, G2

@register("edges_min_downloads", with_sql(D.GRAPH_PACKAGES_SQL, D.EDGES_SQL) + f"""
SELECT DISTINCT source, target FROM edges
WHERE source IN (SELECT name FROM gpackages WHERE recent_downloads >= {EDGE_MIN})
  AND target IN (SELECT name FROM gpackages WHERE recent_downloads >= {EDGE_MIN})""")
def q_edges_min_downloads(spark, sf):
    return G.edges_min_downloads(D.package_edges(spark, sf), D.graph_packages(spark, sf), EDGE_MIN)


@register("edges_all", with_sql(D.EDGES_SQL) + "SELECT DISTINCT source, target FROM edges")
def q_edges_all(spark, sf):
    return G.edges_all(D.package_edges(spark, sf))


# ------------------------------------------------------------------ G3, K4, G6

BFS2_SQL = """
walk(start, package, degree) AS (
  SELECT start, start, 0 FROM nodes
  UNION
  SELECT w.start, u.dst, w.degree + 1 FROM walk w JOIN und u ON w.package = u.src WHERE w.degree < 2
),
bfs AS (SELECT start, package, CAST(min(degree) AS BIGINT) AS degree FROM walk GROUP BY start, package)"""


def _bfs2(spark, sf):
    e = cut_lineage(D.package_edges(spark, sf))
    return G.bfs(e, _nodes(e), 2)


@register("bfs_neighbours", "WITH RECURSIVE " + with_sql(D.EDGES_SQL, NODES_SQL, BFS2_SQL)[5:]
          + "SELECT start, package, degree FROM bfs")
def q_bfs_neighbours(spark, sf):
    return _bfs2(spark, sf)


@register("neighbour_lists", "WITH RECURSIVE " + with_sql(D.EDGES_SQL, NODES_SQL, BFS2_SQL)[5:] + """
SELECT start, degree, part, string_agg(package, ',' ORDER BY package) AS packages FROM (
  SELECT *, CAST((row_number() OVER (PARTITION BY start, degree ORDER BY package) - 1) // 1000 AS BIGINT) AS part FROM bfs) s
GROUP BY start, degree, part""")
def q_neighbour_lists(spark, sf):
    lists = G.neighbours_by_degree(_bfs2(spark, sf))
    return lists.select("start", "degree", "part", F.array_join("packages", ",").alias("packages"))


@register("degree_floor", "WITH RECURSIVE " + with_sql(D.GRAPH_PACKAGES_SQL, D.EDGES_SQL, NODES_SQL, BFS2_SQL)[5:]
          + f"""
, floors AS (SELECT * FROM (VALUES {', '.join(f'({k}, {float(v)})' for k, v in FLOORS.items())}) t(degree, floor))
SELECT b.start, b.degree, b.package, p.recent_downloads, CAST(row_number() OVER (
  PARTITION BY b.start, b.degree ORDER BY p.recent_downloads DESC, b.package) AS BIGINT) AS pos FROM bfs b JOIN floors f ON b.degree = f.degree
JOIN gpackages p ON p.name = b.package WHERE p.recent_downloads > f.floor""")
def q_degree_floor(spark, sf):
    return G.degree_floor(_bfs2(spark, sf), D.graph_packages(spark, sf), FLOORS)


# ------------------------------------------------------------------ G4, G5

def _steps_sql(name: str, edges: str, packages: str, walk: dict, starts: str) -> str:
    """The rule of the pruned walk, a query for each distance: whoever a step of distance k reaches
    must have more downloads than the limit of k."""
    out, before = [], starts
    limits = ", ".join(f"({k}, {walk['base'] * walk['growth'] ** (k - 1)!r})" for k in range(1, walk["max_distance"] + 1))
    out.append(f"{name}_limits AS (SELECT * FROM (VALUES {limits}) v(k, least))")
    for k in range(1, walk["max_distance"] + 1):
        out.append(f"""{name}_{k} AS (
  SELECT DISTINCT here.start, reached.name AS target, reached.recent_downloads
  FROM {before} here, {edges} link, {packages} reached, {name}_limits lim
  WHERE link.source = here.target AND reached.name = link.target AND lim.k = {k} AND reached.recent_downloads > lim.least)""")
        before = f"{name}_{k}"
    every = " UNION ALL ".join(f"SELECT start, target, recent_downloads, {k} AS distance FROM {name}_{k}"
                               for k in range(1, walk["max_distance"] + 1))
    return ",\n".join([*out, f"{name} AS ({every})"])


PRUNED_SQL = _steps_sql("pwalk", "edges", "gpackages", WALK,
                        "(SELECT DISTINCT source AS start, source AS target FROM edges)")


def _pruned(spark, sf):
    e = D.package_edges(spark, sf)
    starts = e.select(F.col("source").alias("start")).distinct()
    return G.pruned_walk(e, D.graph_packages(spark, sf), starts, **WALK)


@register("pruned_walk", with_sql(D.GRAPH_PACKAGES_SQL, D.EDGES_SQL, PRUNED_SQL)
          + "SELECT start, target, recent_downloads, CAST(distance AS BIGINT) AS distance FROM pwalk")
def q_pruned_walk(spark, sf):
    return _pruned(spark, sf)


@register("nearest_distance", with_sql(D.GRAPH_PACKAGES_SQL, D.EDGES_SQL, PRUNED_SQL)
          + """SELECT start, target AS package, CAST(min(distance) AS BIGINT) AS distance,
  min(recent_downloads) AS recent_downloads FROM pwalk GROUP BY start, target""")
def q_nearest_distance(spark, sf):
    return G.nearest_distance(_pruned(spark, sf))


# ------------------------------------------------------------------ G7-G13 (part names)

def _sep_sql(pairs_cte: str, pairs_name: str) -> str:
    return f"""
nund AS (SELECT source AS src, target AS dst FROM nedges UNION SELECT target, source FROM nedges),
sstarts AS (SELECT DISTINCT a AS start FROM {pairs_name}),
swalk(start, node, d) USING KEY (start, node) AS (
  SELECT start, start, 0 FROM sstarts
  UNION
  SELECT w.start, u.dst, min(w.d) + 1 FROM swalk w JOIN nund u ON w.node = u.src
  LEFT JOIN recurring.swalk r ON r.start = w.start AND r.node = u.dst WHERE r.node IS NULL GROUP BY w.start, u.dst
),
sdist AS (SELECT start, node, d FROM swalk),
sep AS (
  SELECT p.a, p.b, CAST(CASE WHEN p.a IN ('ex_unit', 'logger', 'eex') OR p.b IN ('ex_unit', 'logger', 'eex')
    THEN 1 ELSE coalesce(s.d, -1) END AS BIGINT) AS degree
  FROM {pairs_name} p LEFT JOIN sdist s ON p.a = s.start AND p.b = s.node
)"""


NEIGHBOUR_PAIRS_SQL = """
nedges AS (SELECT source, target FROM edges),
named AS (SELECT source AS name FROM edges UNION SELECT target FROM edges),
pairs AS (SELECT name AS a, next AS b FROM (SELECT name, lead(name) OVER (ORDER BY name) AS next FROM named) s WHERE next IS NOT NULL)"""


def _neighbour_pairs(edges):
    """Each package of the graph and the next by name: as many pairs as packages, at any distance."""
    names = G.numbered(edges.select(F.col("source").alias("b")).union(edges.select("target")).distinct()
                       .repartitionByRange("b").sortWithinPartitions("b"), "n")
    return names.join(names.select(F.col("b").alias("a"), (F.col("n") + 1).alias("n")), "n").select("a", "b")


@register("separation", "WITH RECURSIVE " + with_sql(D.EDGES_SQL, NEIGHBOUR_PAIRS_SQL, _sep_sql("", "pairs"))[5:] + "SELECT a, b, degree FROM sep")
def q_separation(spark, sf):
    """Over the part graph, which grows with the orders."""
    edges = cut_lineage(D.package_edges(spark, sf))
    return G.separation(edges, _neighbour_pairs(edges))


SIMILAR_SQL = f"""
heads AS (SELECT name FROM npackages WHERE recent_downloads > {HEAD_MIN}),
sim AS (
  SELECT DISTINCT h.name AS package, n.name AS similar_name, n.recent_downloads
  FROM heads h JOIN npackages n ON n.recent_downloads > {SIMILAR_MIN} AND n.name <> h.name
   AND (starts_with(n.name, h.name || '_') OR contains(n.name, '_' || h.name || '_')
        OR ends_with(n.name, '_' || h.name))
)"""


def _similar(spark, sf):
    p = D.package_names(spark, sf)
    heads = p.where(F.col("recent_downloads") > HEAD_MIN).select("name")
    return S.similarly_named(p, heads, SIMILAR_MIN)


@register("similar_names", with_sql(D.NAMES_SQL, SIMILAR_SQL) + """
SELECT *, CAST(row_number() OVER (PARTITION BY package ORDER BY recent_downloads DESC, similar_name) AS BIGINT) AS pos
FROM sim""")
def q_similar_names(spark, sf):
    return _similar(spark, sf)


SIM_PAIRS_SQL = "simpairs AS (SELECT DISTINCT package AS a, similar_name AS b FROM sim)"


@register("similar_connected", "WITH RECURSIVE " + with_sql(
    D.NAMES_SQL, SIMILAR_SQL, D.NAME_EDGES_SQL, SIM_PAIRS_SQL, _sep_sql("", "simpairs"))[5:] + """
SELECT s.* FROM (SELECT *, CAST(row_number() OVER (PARTITION BY package ORDER BY recent_downloads DESC, similar_name)
  AS BIGINT) AS pos FROM sim) s
JOIN sep ON s.package = sep.a AND s.similar_name = sep.b WHERE sep.degree < 4""")
def q_similar_connected(spark, sf):
    return S.similarly_named_connected(_similar(spark, sf), D.name_edges(spark, sf))


GROUPS_SQL = """
mapping AS (SELECT DISTINCT similar_name AS package, package AS package_group FROM sim),
gpairs AS (SELECT DISTINCT package_group AS a, package AS b FROM mapping)"""
GROUPS_SQL2 = """
connected AS (
  SELECT m.* FROM mapping m JOIN sep ON m.package_group = sep.a AND m.package = sep.b WHERE sep.degree < 4
),
groups AS (
  SELECT DISTINCT c.package, c.package_group FROM connected c
  WHERE NOT EXISTS (SELECT 1 FROM connected o WHERE o.package = c.package AND o.package_group <> c.package_group
                    AND contains(c.package_group, o.package_group))
)"""
GROUPS_FULL_SQL = "WITH RECURSIVE " + with_sql(
    D.NAMES_SQL, SIMILAR_SQL, D.NAME_EDGES_SQL, GROUPS_SQL, _sep_sql("", "gpairs"), GROUPS_SQL2)[5:]


def _groups(spark, sf):
    return S.name_groups(D.package_names(spark, sf), D.name_edges(spark, sf), HEAD_MIN, SIMILAR_MIN)


@register("name_groups", GROUPS_FULL_SQL + "SELECT package, package_group FROM groups")
def q_name_groups(spark, sf):
    return _groups(spark, sf)


@register("group_dedup", with_sql(D.NAMES_SQL, SIMILAR_SQL, GROUPS_SQL) + """
SELECT DISTINCT c.package, c.package_group FROM mapping c
WHERE NOT EXISTS (SELECT 1 FROM mapping o WHERE o.package = c.package AND o.package_group <> c.package_group
                  AND contains(c.package_group, o.package_group))""")
def q_group_dedup(spark, sf):
    sim = _similar(spark, sf)
    return S.group_dedup(sim.select(F.col("similar_name").alias("package"), F.col("package").alias("package_group")))


@register("group_members", GROUPS_FULL_SQL + """
, own AS (SELECT n.name, g.package AS member FROM npackages n JOIN groups g ON n.name = g.package_group)
SELECT DISTINCT name, member FROM (
  SELECT name, member FROM own
  UNION ALL
  SELECT n.name, g2.package AS member FROM npackages n JOIN groups g1 ON g1.package = n.name
  JOIN groups g2 ON g2.package_group = g1.package_group
  WHERE n.name NOT IN (SELECT name FROM own)
) s""")
def q_group_members(spark, sf):
    return S.group_members(_groups(spark, sf), D.package_names(spark, sf))


@register("group_siblings", GROUPS_FULL_SQL + """
SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY recent_downloads DESC, sibling) AS BIGINT) AS pos FROM (
SELECT DISTINCT g1.package AS name, g2.package AS sibling, n.recent_downloads
FROM groups g1 JOIN groups g2 ON g1.package_group = g2.package_group JOIN npackages n ON n.name = g2.package) s""")
def q_group_siblings(spark, sf):
    return S.group_siblings(_groups(spark, sf), D.package_names(spark, sf))


@register("group_classes", GROUPS_FULL_SQL + """
SELECT package_group, package, recent_downloads, count(*) OVER (PARTITION BY package_group) AS n_members,
  CAST(row_number() OVER (PARTITION BY package_group ORDER BY recent_downloads DESC, package) AS BIGINT) AS pos
FROM (SELECT DISTINCT package_group, package FROM groups) g JOIN npackages n ON n.name = g.package""")
def q_group_classes(spark, sf):
    """G13 without a row a pair: every group's members by downloads."""
    return S.group_classes(_groups(spark, sf), D.package_names(spark, sf))


# ------------------------------------------------------------------ F4 BM25 (word index)

@register("bm25", with_sql(D.DOCS_SQL, O.IDX_SQL, O.POSTINGS_SQL, O.requests_sql(BM25_REQUESTS), O.clauses_sql())
          + """
, rpall AS (SELECT request_id, CAST(0 AS BIGINT) AS package_pos, '*' AS package FROM meta),
""" + O.MATCH_SQL.strip().replace("JOIN rp ON ctx.request_id = rp.request_id",
                                  "JOIN rpall rp ON ctx.request_id = rp.request_id").replace(
                                  "JOIN postings p ON p.package = c.package",
                                  "JOIN (SELECT '*' AS package, id, col, pos, term FROM postings) p "
                                  "ON p.package = c.package") + """,
dl AS (SELECT id, len(tt) + len(dt) AS dl FROM ptok),
st AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl FROM dl),
freq AS (SELECT request_id, clause_no, id, count(*) AS f FROM inst WHERE kind <> 'absent' GROUP BY ALL),
nph AS (SELECT request_id, clause_no, count(DISTINCT id) AS n FROM freq GROUP BY ALL),
sc AS (
  SELECT f.request_id, f.id, -sum(
    (CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END)
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank
  FROM freq f JOIN nph USING (request_id, clause_no) JOIN dl USING (id), st
  GROUP BY f.request_id, f.id
)
SELECT s.request_id, s.id, round(s.rank, 6) AS rank FROM sc s
JOIN matched m ON m.request_id = s.request_id AND m.id = s.id""")
def q_bm25(spark, sf):
    from folio.plans.catalog import _index
    reqs = R.requests_frame(spark, BM25_REQUESTS)
    c = R.clauses(reqs)
    postings, terms, lengths, vocab = (_index(spark, sf, t) for t in ("postings", "terms", "lengths", "vocab"))
    r = RK.bm25_words(postings, terms, lengths, c, R.request_meta(reqs, c), vocab)
    return r.select("request_id", "id", F.round("rank", 6).alias("rank"))


# ------------------------------------------------------------------ F4 trigram, F5-F11

TRIGRAM_SQL = """
ac AS (SELECT id, package, lower(atitle) AS lt, greatest(length(atitle) - 2, 0) AS dl FROM acorpus
       WHERE atitle IS NOT NULL),
acst AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl FROM ac),
tphr AS (SELECT request_id, clause_no, kind, lower(text) AS needle FROM clauses
         WHERE request_id IN (SELECT request_id FROM meta WHERE valid) AND length(text) >= 3),
thits AS (
  SELECT p.request_id, p.clause_no, p.kind, a.id, a.dl,
    len(list_filter(range(1, length(a.lt) - length(p.needle) + 2),
                    lambda i: substr(a.lt, i, length(p.needle)) = p.needle)) AS f
  FROM tphr p JOIN ac a ON contains(a.lt, p.needle)
),
tkeep AS (
  SELECT a.request_id, a.id FROM (
    SELECT request_id, id, count(DISTINCT CASE WHEN kind = 'required' THEN clause_no END) AS req_hits,
      bool_or(kind = 'optional') AS opt_hit, bool_or(kind = 'absent') AS abs_hit
    FROM thits GROUP BY request_id, id) a JOIN meta m ON a.request_id = m.request_id
  WHERE m.valid AND a.req_hits = m.n_required AND (m.n_optional = 0 OR a.opt_hit) AND NOT a.abs_hit
),
tn AS (SELECT request_id, clause_no, count(DISTINCT id) AS n FROM thits WHERE kind <> 'absent' GROUP BY ALL),
tranks AS (
  SELECT t.request_id, t.id, -sum(
    (CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END)
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank
  FROM thits t JOIN tn USING (request_id, clause_no) JOIN tkeep k ON k.request_id = t.request_id AND k.id = t.id,
    acst
  WHERE t.kind <> 'absent'
  GROUP BY t.request_id, t.id
)"""

DOC_WALK_SQL = _steps_sql("dwalk", "dedges", "packages", DOC_WALK,
                          "(SELECT DISTINCT packages AS start, packages AS target FROM requests)") + """,
nearest AS (
  SELECT r.request_id, w.target AS package, min(w.distance) AS distance
  FROM requests r JOIN dwalk w ON w.start = r.packages GROUP BY r.request_id, w.target
)"""


def _blend_sql(floor, tail: str) -> str:
    return with_sql(
        D.DOCS_SQL, D.SEARCH_PACKAGES_SQL, D.DOC_EDGES_SQL,
        __import__("folio.plans.catalog", fromlist=["x"]).AUTOCOMPLETE_CORPUS_SQL,
        O.requests_sql(BLEND_REQUESTS), O.clauses_sql(("title",)), TRIGRAM_SQL, DOC_WALK_SQL, f"""
brows AS (
  SELECT r.request_id, r.id, d.package, d.ref, d.title, r.rank, p.recent_downloads,
    CAST(n.distance AS BIGINT) AS distance
  FROM tranks r JOIN docs d ON r.id = d.id JOIN packages p ON d.package = p.name AND p.recent_downloads > {floor}
  LEFT JOIN nearest n ON n.request_id = r.request_id AND n.package = d.package
)""") + tail


def _tranks(spark, sf, rows):
    reqs = R.requests_frame(spark, rows)
    c = R.clauses(reqs)
    meta = R.request_meta(reqs, c, allowed_fields=("title",))
    from folio.plans.catalog import _index
    return reqs, RK.bm25_trigram(_index(spark, sf, "atitles"), c, meta, tri_index=_index(spark, sf, "atrigrams"),
                                 tri_counts=_index(spark, sf, "atricounts"))


def _walked(spark, sf, reqs):
    """``(request_id, package, distance)``: the walk from each request's package, a row for each distance that reaches a package."""
    starts = reqs.select(F.col("packages").alias("start")).distinct()
    walk = G.pruned_walk(D.doc_package_edges(spark, sf), D.search_packages(spark, sf), starts, **DOC_WALK)
    return reqs.select("request_id", F.col("packages").alias("start")).join(walk, "start").select(
        "request_id", F.col("target").alias("package"), "distance", "recent_downloads")


def _nearest(spark, sf, reqs):
    return _walked(spark, sf, reqs).groupBy("request_id", "package").agg(F.min("distance").alias("distance"))


def _blend_rows(spark, sf, floor, within=None):
    reqs, ranks = _tranks(spark, sf, BLEND_REQUESTS)
    return RK.blend_rows(ranks, D.docs(spark, sf), D.search_packages(spark, sf), floor, _nearest(spark, sf, reqs), within)


BLEND_COLS = ["request_id", "pos", "id", "package", "ref", "title", "rank", "recent_downloads", "distance"]


def _out(df, extra=()):
    return df.select(*[F.round("rank", 6).alias("rank") if c == "rank" else c for c in BLEND_COLS], *extra)


@register("blend_distance", _blend_sql(BLEND_FLOOR, """
SELECT request_id, pos, id, package, ref, title, round(rank, 6) AS rank, recent_downloads, distance, score1, score2
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score1, score2 DESC, id) AS BIGINT) AS pos
      FROM (SELECT *, CAST(round(rank / 2) AS BIGINT) AS score1,
                   recent_downloads // coalesce(distance, 5) AS score2 FROM brows) s0) s
WHERE pos <= 10"""))
def q_blend_distance(spark, sf):
    return _out(RK.blend_distance(_blend_rows(spark, sf, BLEND_FLOOR)), ("score1", "score2"))


@register("blend_report", _blend_sql(BLEND_FLOOR, """
SELECT request_id, pos, id, package, ref, title, round(rank, 6) AS rank, recent_downloads, distance, score1, score2
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank, id) AS BIGINT) AS pos
      FROM (SELECT *, CAST(round(rank / 2) AS BIGINT) AS score1,
                   (recent_downloads // 2000000) * coalesce(distance, 1) AS score2 FROM brows) s0) s
WHERE pos <= 10"""))
def q_blend_report(spark, sf):
    return _out(RK.blend_report(_blend_rows(spark, sf, BLEND_FLOOR)), ("score1", "score2"))


@register("blend_downloads_25", _blend_sql(BLEND_FLOOR, """
SELECT request_id, pos, id, package, ref, title, round(rank, 6) AS rank, recent_downloads, distance
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id
                     ORDER BY rank - recent_downloads // 50000, id) AS BIGINT) AS pos FROM brows) s
WHERE pos <= 25"""))
def q_blend_downloads_25(spark, sf):
    return _out(RK.blend_downloads(_blend_rows(spark, sf, BLEND_FLOOR), 1.0, 50_000, 25))


BLEND_WITHIN = [(1, "src0"), (1, "src3"), (2, "src5"), (4, "src3"), (4, "src7"), (6, "nope")]


@register("blend_downloads_within", _blend_sql(BLEND_FLOOR, f"""
SELECT request_id, pos, id, package, ref, title, round(rank, 6) AS rank, recent_downloads, distance
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id
                     ORDER BY rank - recent_downloads // 50000, id) AS BIGINT) AS pos
      FROM brows b WHERE request_id NOT IN ({', '.join(str(r) for r, _ in BLEND_WITHIN)})
        OR (request_id, package) IN (VALUES {', '.join(f"({r}, '{p}')" for r, p in BLEND_WITHIN)})) s
WHERE pos <= 25"""))
def q_blend_downloads_within(spark, sf):
    """F7 with its package restriction: some requests name packages, the others have all."""
    within = spark.createDataFrame(BLEND_WITHIN, "request_id bigint, package string")
    return _out(RK.blend_downloads(_blend_rows(spark, sf, BLEND_FLOOR, within), 1.0, 50_000, 25))


@register("blend_downloads_10", _blend_sql(-1, """
SELECT request_id, pos, id, package, ref, title, round(rank, 6) AS rank, recent_downloads, distance
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id
                     ORDER BY rank / 5 - recent_downloads // 40000, id) AS BIGINT) AS pos FROM brows) s
WHERE pos <= 10"""))
def q_blend_downloads_10(spark, sf):
    return _out(RK.blend_downloads(_blend_rows(spark, sf, -1), 5.0, 40_000, 10))


@register("popular_only", _blend_sql(125_000, """
SELECT request_id, pos, id, package, ref, title, round(rank, 6) AS rank, recent_downloads, distance
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank, id) AS BIGINT) AS pos
      FROM brows WHERE package <> 'src0') s
WHERE pos <= 10"""))
def q_popular_only(spark, sf):
    rows = _blend_rows(spark, sf, 125_000).where(F.col("package") != "src0")
    return _out(RK.top_k(rows, 10, ["rank", "id"]))


@register("group_only", _blend_sql(BLEND_FLOOR, """
SELECT request_id, pos, id, package, ref, title, round(rank, 6) AS rank, recent_downloads, distance
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank, id) AS BIGINT) AS pos
      FROM brows WHERE package IN (SELECT package FROM (""" + D.DOC_GROUPS_SQL.strip()[len("dgroups AS ("):-1]
                                  + """) g WHERE package_group = 'en')) s
WHERE pos <= 10"""))
def q_group_only(spark, sf):
    groups = D.doc_package_groups(spark, sf).where(F.col("package_group") == "en").select("package")
    rows = _blend_rows(spark, sf, BLEND_FLOOR).join(groups, "package", "left_semi")
    return _out(RK.top_k(rows, 10, ["rank", "id"]))


@register("neighbour_first", _blend_sql(-1, """
, walked AS (SELECT DISTINCT r.request_id, w.target AS package, w.distance FROM requests r JOIN dwalk w ON w.start = r.packages)
SELECT DISTINCT request_id, id, title, round(rank, 6) AS rank FROM (
  SELECT request_id, id, title, rank FROM (SELECT b.*, row_number() OVER (PARTITION BY b.request_id ORDER BY rank, id, w.distance) AS pos
                 FROM brows b JOIN walked w ON w.request_id = b.request_id AND w.package = b.package) a WHERE pos <= 10
  UNION ALL
  SELECT request_id, id, title, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank, id) AS pos
                 FROM brows) b WHERE pos <= 10
) s"""))
def q_neighbour_first(spark, sf):
    reqs, ranks = _tranks(spark, sf, BLEND_REQUESTS)
    rows = RK.blend_rows(ranks, D.docs(spark, sf), D.search_packages(spark, sf), -1)
    return RK.neighbour_first(rows, _walked(spark, sf, reqs)).withColumn("rank", F.round("rank", 6))


@register("bm25_titles", _blend_sql(-1, """
SELECT request_id, id, round(rank, 6) AS rank FROM tranks"""))
def q_bm25_titles(spark, sf):
    _, ranks = _tranks(spark, sf, BLEND_REQUESTS)
    return ranks.select("request_id", "id", F.round("rank", 6).alias("rank"))
