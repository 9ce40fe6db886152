"""DuckDB SQL building blocks for the correctness oracle.

Each block is a CTE over the driver's registered tables, written independently
of the Spark code from the same rules, so a query and its oracle agree only
when both implement the rule.
"""

from __future__ import annotations

from folio.functions.titles import CODE_TYPES, PAGE_TYPES
from folio.sources.testdata import DOCS_SQL, with_sql

TOKEN_RE = r"[\p{L}\p{N}\p{Co}]+"


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def strings(values: list[str]) -> str:
    return ", ".join(q(v) for v in values)


def extras_sql(title: str, glue: str = "") -> str:
    parts = f"string_split({title}, ' - ')"
    return (f"(CASE WHEN len({parts}) = 1 THEN {title} "
            f"ELSE array_to_string(list_slice({parts}, 1, len({parts}) - 1), {q(glue)}) END)")


def index_title_sql(type_: str = "type", title: str = "title") -> str:
    return (f"(CASE WHEN {type_} IN ({strings(CODE_TYPES)}) THEN "
            f"(CASE WHEN contains({title}, ' - ') THEN {extras_sql(title)} "
            f"ELSE string_split({title}, '.')[-1] END) "
            f"WHEN {type_} IN ({strings(PAGE_TYPES)}) THEN {extras_sql(title)} "
            f"WHEN {type_} = 'task' THEN {title} END)")


def underscore_sql(p: str) -> str:
    step1 = (f"(substr({p}, 1, 1) || regexp_replace(substr({p}, 2), '([A-Z])([^A-Z0-9._])', "
             f"'_\\1\\2', 'g'))")
    step2 = f"regexp_replace({step1}, '([^A-Z_])([A-Z])', '\\1_\\2', 'g')"
    return f"translate({step2}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def task_title_sql(title: str = "title") -> str:
    parts = f"list_transform(string_split({title}, '.'), lambda p: {underscore_sql('p')})"
    mix = (f"(CASE WHEN {parts}[1] = 'mix' AND {parts}[2] = 'tasks' THEN "
           f"array_to_string(list_slice({parts}, 3, len({parts})), ' ') END)")
    shell = f"(CASE WHEN len(string_split({title}, ' ')) = 2 THEN replace({title}, '.', ' ') END)"
    return (f"(CASE WHEN contains({title}, ' - ') THEN {extras_sql(title)} "
            f"WHEN starts_with({title}, 'Mix.') THEN {mix} "
            f"WHEN starts_with({title}, 'mix ') THEN {shell} END)")


def tokens_sql(expr: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({expr})), '{TOKEN_RE}')"


IDX_SQL = f"""
idx AS (
  SELECT id, package, ref, type, title, {index_title_sql()} AS ititle, doc FROM docs
)"""

POSTINGS_SQL = f"""
ptok AS (
  SELECT package, id, {tokens_sql('ititle')} AS tt, {tokens_sql('doc')} AS dt
  FROM idx WHERE ititle IS NOT NULL
),
postings AS (
  SELECT package, id, 0 AS col, CAST(generate_subscripts(tt, 1) - 1 AS BIGINT) AS pos, unnest(tt) AS term
  FROM ptok
  UNION ALL
  SELECT package, id, 1 AS col, CAST(generate_subscripts(dt, 1) - 1 AS BIGINT) AS pos, unnest(dt) AS term
  FROM ptok
)"""


def requests_sql(rows) -> str:
    vals = ", ".join(f"(CAST({r[0]} AS BIGINT), {q(r[1])}, {q(r[2])})" for r in rows)
    return f"""
requests AS (
  SELECT * FROM (VALUES {vals}) t(request_id, q, packages)
)"""


def clauses_sql(allowed_fields=("title", "doc")) -> str:
    allowed = ", ".join(q(f) for f in allowed_fields)
    return f"""
segs AS (
  SELECT request_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS clause_no, unnest(l) AS seg
  FROM (SELECT request_id, list_filter(string_split(coalesce(q, ''), ' '), lambda x: x <> '') AS l
        FROM requests) s
),
c1 AS (
  SELECT request_id, clause_no, seg,
    CASE WHEN starts_with(seg, '-') THEN 'absent' WHEN starts_with(seg, '+') THEN 'required'
         ELSE 'optional' END AS kind
  FROM segs
),
c2 AS (
  SELECT *, ends_with(body, '*') AS is_prefix, replace(body, '*', '') AS stripped
  FROM (SELECT *, CASE WHEN kind = 'optional' THEN seg ELSE substr(seg, 2) END AS body FROM c1) s
),
c3 AS (
  SELECT *, regexp_extract(stripped, '(?s)^((?:title:|doc:)*)(.*)$', 1) AS prefixes,
    regexp_extract(stripped, '(?s)^((?:title:|doc:)*)(.*)$', 2) AS rest,
    regexp_extract(stripped, '^(title|doc):', 1) AS first_field
  FROM c2
),
c4 AS (
  SELECT *, prefixes || (CASE WHEN rest = '' THEN '' ELSE '"' || replace(rest, '"', '""') || '"' END)
    || (CASE WHEN is_prefix THEN '*' ELSE '' END) AS operand
  FROM c3
),
clauses AS (
  SELECT request_id, clause_no, kind,
    CASE WHEN first_field = '' THEN NULL ELSE first_field END AS field,
    CASE WHEN first_field = '' THEN stripped ELSE substr(stripped, length(first_field) + 2) END AS text,
    is_prefix,
    CASE WHEN kind = 'absent' THEN 'NOT ' || operand ELSE operand END AS rendered,
    (operand = '' OR operand = '*' OR (prefixes <> '' AND rest = '')
      OR length(prefixes) > length(first_field) + 1) AS bad
  FROM c4
),
meta0 AS (
  SELECT request_id,
    CAST(sum(CASE WHEN kind = 'required' THEN 1 ELSE 0 END) AS BIGINT) AS n_required,
    CAST(sum(CASE WHEN kind = 'optional' THEN 1 ELSE 0 END) AS BIGINT) AS n_optional,
    CAST(sum(CASE WHEN kind = 'absent' THEN 1 ELSE 0 END) AS BIGINT) AS n_absent,
    bool_or(bad OR (field IS NOT NULL AND field NOT IN ({allowed}))) AS any_bad
  FROM clauses GROUP BY request_id
),
meta AS (
  SELECT r.request_id, coalesce(n_required, 0) AS n_required, coalesce(n_optional, 0) AS n_optional,
    coalesce(n_absent, 0) AS n_absent,
    (coalesce(n_required, 0) + coalesce(n_optional, 0) > 0 AND NOT coalesce(any_bad, false)) AS valid
  FROM requests r LEFT JOIN meta0 m ON r.request_id = m.request_id
),
rp AS (
  SELECT request_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS package_pos, unnest(l) AS package
  FROM (SELECT request_id, string_split(packages, ',') AS l FROM requests WHERE packages IS NOT NULL) s
)"""


MATCH_SQL = f"""
ct AS (
  SELECT request_id, clause_no, kind,
    CASE WHEN field = 'title' THEN 0 WHEN field = 'doc' THEN 1 END AS field_col,
    is_prefix, {tokens_sql('text')} AS toks
  FROM clauses
),
ctx AS (
  SELECT request_id, clause_no, kind, field_col, n_tokens, tok_idx, toks[tok_idx + 1] AS token,
    (is_prefix AND tok_idx = n_tokens - 1) AS is_prefix_tok
  FROM (SELECT *, CAST(len(toks) AS BIGINT) AS n_tokens,
               unnest(range(len(toks))) AS tok_idx FROM ct) s
),
ctp AS (
  SELECT ctx.*, rp.package_pos, rp.package FROM ctx JOIN rp ON ctx.request_id = rp.request_id
  WHERE ctx.request_id IN (SELECT request_id FROM meta WHERE valid)
),
hits AS (
  SELECT c.request_id, c.package_pos, c.package, c.clause_no, c.kind, c.n_tokens, p.id, p.col,
    p.pos - c.tok_idx AS start
  FROM ctp c JOIN postings p ON p.package = c.package
   AND (CASE WHEN c.is_prefix_tok THEN starts_with(p.term, c.token) ELSE p.term = c.token END)
  WHERE c.field_col IS NULL OR p.col = c.field_col
),
inst AS (
  SELECT request_id, package_pos, package, clause_no, kind, id, col FROM hits WHERE n_tokens = 1
  UNION ALL
  SELECT request_id, package_pos, package, clause_no, kind, id, col FROM hits WHERE n_tokens > 1
  GROUP BY request_id, package_pos, package, clause_no, kind, n_tokens, id, col, start
  HAVING count(*) = n_tokens
),
matched AS (
  SELECT a.request_id, a.package_pos, a.package, a.id, a.title_hit
  FROM (
    SELECT request_id, package_pos, package, id,
      count(DISTINCT CASE WHEN kind = 'required' THEN clause_no END) AS req_hits,
      bool_or(kind = 'optional') AS opt_hit, bool_or(kind = 'absent') AS abs_hit,
      bool_or(col = 0 AND kind <> 'absent') AS title_hit
    FROM inst GROUP BY request_id, package_pos, package, id
  ) a JOIN meta m ON a.request_id = m.request_id
  WHERE m.valid AND a.req_hits = m.n_required AND (m.n_optional = 0 OR a.opt_hit) AND NOT a.abs_hit
)"""


SEARCH_SQL = """
ranked AS (
  SELECT *, CASE WHEN title_hit THEN 2.0 ELSE 1.0 END::DOUBLE AS base_rank FROM matched
),
top AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY request_id, package_pos ORDER BY base_rank DESC, id)
      AS BIGINT) AS pkg_rank FROM ranked) s
  WHERE pkg_rank <= {k}
),
boosted AS (
  SELECT t.request_id, t.package_pos, t.package, t.id, d.ref, d.type, d.title, t.base_rank, t.pkg_rank,
    (CASE WHEN d.type = 'module' THEN (CASE WHEN contains(d.title, ' ') THEN 0.1 ELSE 0.2 END)
          WHEN d.type IN ('function', 'callback', 'macro')
            THEN (CASE WHEN contains(d.title, ' ') THEN 0.1 ELSE 0.3 END)
          WHEN d.type = 'task' THEN 0.1 ELSE 0.0 END)::DOUBLE AS boost
  FROM top t JOIN docs d ON t.package = d.package AND t.id = d.id
),
results AS (
  SELECT request_id,
    CAST(row_number() OVER (PARTITION BY request_id ORDER BY base_rank + boost DESC, package_pos, pkg_rank)
      AS BIGINT) AS result_pos,
    package_pos, package, id, ref, type, title, base_rank, boost, base_rank + boost AS rank, pkg_rank
  FROM boosted
)"""


def _measure(stem: str, least: int) -> str:
    """SQL: the stem has at least ``least`` vowel-consonant sequences."""
    seq = "[aeiouy][aeiou]*[^aeiou][^aeiouy]*"
    return f"regexp_matches({stem}, '^([^aeiou][^aeiouy]*)?{seq * least}')"


def _ending(step: int, rules: list[tuple[str, str, str]], w: str = "w") -> str:
    """SQL of a step: of the suffixes of a word the longest decides; (suffix, condition on the stem s, result)."""
    whens = []
    for suffix, test, result in sorted(rules, key=lambda r: -len(r[0])):
        stem = f"left({w}, -{len(suffix)})"
        whens.append(f"WHEN ends_with({w}, '{suffix}') THEN CASE WHEN {test.replace('s~', stem)} THEN {result.replace('s~', stem)} ELSE {w} END")
    return f"p{step} AS (SELECT term, CASE {' '.join(whens)} ELSE {w} END AS w FROM p{step - 1})"


def stems_sql(terms: str) -> str:
    """stems(term, stem) of the words that ``terms`` selects, by the steps of Porter's paper."""
    vowel = "regexp_matches(s~, '^([^aeiou][^aeiouy]*)?[aeiouy]')"
    short = "regexp_matches({0}, '^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$') AND ascii(right({0}, 1)) < 128"
    m1 = f"({_measure('s~', 1)} AND NOT {_measure('s~', 2)})"
    swap = lambda rules, least: [(a, _measure("s~", least), f"s~ || '{b}'") for a, b in rules]
    from folio.functions.porter import STEP2, STEP3, STEP4
    step4 = [(x, ("right(s~, 1) IN ('s', 't') AND " if x == "ion" else "") + _measure("s~", 2), "s~") for x in STEP4]
    return ",\n".join([
        f"p0 AS (SELECT term, term AS w FROM ({terms}) t)",
        _ending(1, [("sses", "true", "s~ || 'ss'"), ("ies", "true", "s~ || 'i'"), ("ss", "true", "s~ || 'ss'"), ("s", "true", "s~")]),
        _ending(2, [("eed", _measure("s~", 1), "s~ || 'ee'"), ("ed", vowel, "s~ || '#'"), ("ing", vowel, "s~ || '#'")]),
        f"""p3 AS (SELECT term, CASE WHEN NOT ends_with(w, '#') THEN w
      WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
      WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND ascii(right(b, 1)) < 128
        AND right(b, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z') THEN left(b, -1)
      WHEN {short.format('b')} THEN b || 'e' ELSE b END AS w
    FROM (SELECT term, w, replace(w, '#', '') AS b FROM p2) x)""",
        _ending(4, [("y", vowel, "s~ || 'i'")]), _ending(5, swap(STEP2, 1)), _ending(6, swap(STEP3, 1)), _ending(7, step4),
        _ending(8, [("e", f"({_measure('s~', 2)} OR ({m1} AND NOT ({short.format('s~')})))", "s~")]),
        f"p9 AS (SELECT term, CASE WHEN ends_with(w, 'll') AND {_measure('w', 2)} THEN left(w, -1) ELSE w END AS w FROM p8)",
        "stems AS (SELECT term, CASE WHEN octet_length(encode(term)) BETWEEN 3 AND 64 THEN w ELSE term END AS stem FROM p9)"])


def search_sql(rows, k: int = 25, stem: bool = False) -> str:
    if not stem:
        return with_sql(DOCS_SQL, IDX_SQL, POSTINGS_SQL, requests_sql(rows), clauses_sql(), MATCH_SQL,
                        SEARCH_SQL.format(k=k))
    asked = f"SELECT term FROM words UNION SELECT unnest({tokens_sql('text')}) FROM clauses"
    return with_sql(
        DOCS_SQL, IDX_SQL, POSTINGS_SQL.replace("postings AS (", "words AS ("), requests_sql(rows), clauses_sql(),
        stems_sql(asked), "postings AS (SELECT package, id, col, pos, stem AS term FROM words JOIN stems USING (term))",
        MATCH_SQL.replace("ctx AS (", "ctx0 AS (").replace("ctp AS (", """ctx AS (
  SELECT c.* REPLACE (coalesce(s.stem, c.token) AS token) FROM ctx0 c LEFT JOIN stems s ON s.term = c.token
),
ctp AS ("""), SEARCH_SQL.format(k=k))


RAW_RE = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"

# Every candidate window scored by a join with the hits inside it; text put together token by token.
EXCERPT_SQL = f"""
asked AS (SELECT DISTINCT request_id, package, id FROM results),
body AS (
  SELECT package, id, doc, regexp_extract_all(doc, '{RAW_RE}') AS raw, regexp_split_to_array(doc, '{RAW_RE}') AS gaps
  FROM docs WHERE (package, id) IN (SELECT (package, id) FROM asked)
),
xhits AS (
  SELECT request_id, package, id, p, k, o FROM (
    SELECT DISTINCT a.request_id, a.package, a.id, c.clause_no AS p, c.n_tokens AS k, t.pos - c.tok_idx AS o, c.tok_idx
    FROM asked a JOIN ctx c ON a.request_id = c.request_id AND c.kind <> 'absent' AND coalesce(c.field_col, 1) = 1
    JOIN postings t ON t.package = a.package AND t.id = a.id AND t.col = 1
     AND (CASE WHEN c.is_prefix_tok THEN starts_with(t.term, c.token) ELSE t.term = c.token END)) s
  GROUP BY request_id, package, id, p, k, o HAVING count(*) = k
),
sentences AS (
  SELECT package, id, f FROM (SELECT package, id, gaps, unnest(range(len(raw))) AS f FROM body) s
  WHERE f = 0 OR regexp_matches(gaps[f + 1], '[.:][ \t\n\r]+$')
),
cands AS (
  SELECT request_id, package, id, o, p, k, 0 AS c, o AS s FROM xhits
  UNION ALL
  SELECT * FROM (
    SELECT h.request_id, h.package, h.id, h.o, h.p, h.k, 1 AS c, max(f) AS s
    FROM xhits h JOIN sentences USING (package, id) JOIN body USING (package, id)
    WHERE f <= h.o AND len(raw) > 20 GROUP BY h.request_id, h.package, h.id, h.o, h.p, h.k) t WHERE s < o
),
scored AS (
  SELECT c.request_id, c.package, c.id, c.o, c.p, c.k, c.c, c.s,
    1000 * count(DISTINCT h.p) + count(*) - count(DISTINCT h.p)
      + CASE WHEN c.c = 0 THEN 0 WHEN c.s = 0 THEN 120 ELSE 100 END AS score,
    min(h.o) AS first, max(struct_pack(o := h.o, p := h.p, k := h.k)) AS last
  FROM cands c JOIN xhits h ON h.request_id = c.request_id AND h.package = c.package AND h.id = c.id AND h.o >= c.s AND h.o < c.s + 20
  GROUP BY c.request_id, c.package, c.id, c.o, c.p, c.k, c.c, c.s
),
chosen AS (
  SELECT a.request_id, a.package, a.id, b.doc, b.raw, b.gaps,
    CASE WHEN s.c IS NULL THEN 0 WHEN s.c = 1 THEN s.s
      ELSE greatest(least(s.first - trunc((20 - (s.last.o + s.last.k - s.first)) / 2)::BIGINT, len(raw) - 20), 0) END AS start
  FROM asked a JOIN body b USING (package, id) LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY request_id, package, id ORDER BY score DESC, o, p, k, c) AS n FROM scored) s
    ON s.request_id = a.request_id AND s.package = a.package AND s.id = a.id AND s.n = 1
),
parted AS (
  SELECT *, sum(fresh) OVER (PARTITION BY request_id, package, id ORDER BY o, p, k) AS part FROM (
    SELECT *, CASE WHEN o <= max(o + k - 1) OVER (PARTITION BY request_id, package, id ORDER BY o, p, k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM xhits) t
),
marks AS (
  SELECT request_id, package, id, min(o) AS s, max(o + k - 1) AS e FROM parted GROUP BY request_id, package, id, part
),
toks20 AS (
  SELECT *, unnest(range(start, least(start + 20, len(raw)))) AS i FROM chosen WHERE len(raw) > 0
),
shown AS (
  SELECT t.request_id, t.package, t.id, string_agg(
    CASE WHEN i > start OR start = 0 THEN gaps[i + 1] ELSE '' END
    || CASE WHEN EXISTS (FROM marks m WHERE m.request_id = t.request_id AND m.package = t.package AND m.id = t.id
                         AND m.s >= t.start AND m.s = i) THEN '<em>' ELSE '' END
    || raw[i + 1]
    || CASE WHEN EXISTS (FROM marks m WHERE m.request_id = t.request_id AND m.package = t.package AND m.id = t.id
                         AND m.s >= t.start AND m.s <= i AND (m.e = i OR (i = t.start + 19 AND m.e > i))) THEN '</em>' ELSE '' END, '' ORDER BY i) AS body
  FROM toks20 t GROUP BY t.request_id, t.package, t.id
),
excerpted AS (
  SELECT c.request_id, c.package, c.id,
    CASE WHEN body IS NULL THEN doc ELSE CASE WHEN start > 0 THEN '...' ELSE '' END || body
      || CASE WHEN start + 20 < len(raw) THEN '...' ELSE gaps[-1] END END AS excerpt
  FROM chosen c LEFT JOIN shown USING (request_id, package, id)
)"""


def excerpts_sql(rows, stem: bool = False) -> str:
    """The CTEs of ``search_sql`` and ``excerpted(request_id, package, id, excerpt)``."""
    return search_sql(rows, stem=stem).rstrip() + "," + EXCERPT_SQL + "\n"


AUTOCOMPLETE_SQL = """
cp AS (
  SELECT c.request_id, r.package_pos, r.package, c.clause_no, c.kind, lower(c.text) AS needle
  FROM clauses c JOIN rp r ON c.request_id = r.request_id
  WHERE c.request_id IN (SELECT request_id FROM meta WHERE valid) AND length(c.text) >= 3
),
inst AS (
  SELECT cp.request_id, cp.package_pos, cp.package, cp.clause_no, cp.kind, i.id, 0 AS col
  FROM cp JOIN idx i ON i.package = cp.package AND contains(lower(i.ititle), cp.needle)
  WHERE i.ititle IS NOT NULL
),
matched AS (
  SELECT a.request_id, a.package_pos, a.package, a.id
  FROM (
    SELECT request_id, package_pos, package, id,
      count(DISTINCT CASE WHEN kind = 'required' THEN clause_no END) AS req_hits,
      bool_or(kind = 'optional') AS opt_hit, bool_or(kind = 'absent') AS abs_hit
    FROM inst GROUP BY request_id, package_pos, package, id
  ) a JOIN meta m ON a.request_id = m.request_id
  WHERE m.valid AND a.req_hits = m.n_required AND (m.n_optional = 0 OR a.opt_hit) AND NOT a.abs_hit
),
top AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY request_id, package_pos ORDER BY id) AS BIGINT)
      AS pkg_rank FROM matched) s
  WHERE pkg_rank <= {k}
),
results AS (
  SELECT t.request_id,
    CAST(row_number() OVER (PARTITION BY t.request_id ORDER BY t.package_pos, t.pkg_rank) AS BIGINT)
      AS result_pos,
    t.package_pos, t.package, t.id, d.title, d.ref, d.type
  FROM top t JOIN docs d ON t.package = d.package AND t.id = d.id
)"""


def autocomplete_sql(rows, k: int = 3) -> str:
    return with_sql(DOCS_SQL, IDX_SQL, requests_sql(rows), clauses_sql(("title",)),
                    AUTOCOMPLETE_SQL.format(k=k))
