"""Queries of symbols, imports, the file graph and code-aware ranking, on files derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, search, structure
from ..sources.files import derived_files
from .common import table

TERMS = ["model", "run", "function", "eableon"]
SEEDS = (0, 6, 14)


def _files(spark, sf_dir):
    return derived_files(table(spark, sf_dir, "documents"))


def _resolved(spark, sf_dir):
    files = _files(spark, sf_dir)
    return structure.resolve(structure.dependencies(files), files)


def classify_role(spark, sf_dir):
    role = T.classify_path(F.col("path"))
    return _files(spark, sf_dir).select("doc_id", "path", role.alias("role"), T.role_priority(role).cast("long").alias("priority"))


def role_counts(spark, sf_dir):
    """Roles of the paths of all pages."""
    path = F.concat(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), F.when(F.col("page_id") % 3 == 0, "/docs/a.md").when(F.col("page_id") % 3 == 1, "/src/b.test.ts").otherwise(""))
    return table(spark, sf_dir, "pages").groupBy(T.classify_path(path).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def extract_symbols(spark, sf_dir):
    return structure.symbols(_files(spark, sf_dir)).select("path", "name", "kind", F.col("line").cast("long").alias("line"), "signature", "exported")


def extract_dependencies(spark, sf_dir):
    return structure.dependencies(_files(spark, sf_dir)).select("path", "specifier", F.col("line").cast("long").alias("line"))


def href_dependencies(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))).alias("target"))
    return pages.groupBy("target").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


def resolve_dependencies(spark, sf_dir):
    return _resolved(spark, sf_dir).select("path", "specifier", F.col("line").cast("long").alias("line"), "resolved_path")


def imported_by(spark, sf_dir):
    rows = _resolved(spark, sf_dir).where("resolved_path IS NOT NULL")
    return rows.groupBy("resolved_path").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def graph_degree(spark, sf_dir):
    return graph.degrees(_files(spark, sf_dir), _resolved(spark, sf_dir))


def related_files(spark, sf_dir):
    files = _files(spark, sf_dir)
    rows = graph.neighbours(_resolved(spark, sf_dir), structure.symbols(files), 2)
    return rows.select("path", "kind", "item", F.col("line").cast("long").alias("line"), F.col("at").cast("long").alias("at"))


def related_graph_bfs(spark, sf_dir):
    seeds = _files(spark, sf_dir).where(F.col("doc_id").isin(*SEEDS)).select("path", F.col("doc_id").alias("order"))
    return graph.walk(_resolved(spark, sf_dir), seeds, 3, 40).select("path", "depth", "via", "position")


def rerank(spark, sf_dir):
    files, resolved = _files(spark, sf_dir), _resolved(spark, sf_dir)
    names = structure.symbols(files).groupBy("path").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda s: s["name"]), 1, 80).alias("symbols"))
    base = files.select("path", T.compact_snippet(F.col("text"), 400).alias("snippet"), (F.col("doc_id") % 17 / 10).alias("score"))
    rows = base.join(names, "path").join(graph.degrees(files, resolved), "path")
    got = search.rerank(rows, TERMS).select("path", F.round("rank_score", 6).alias("rank_score"))
    return got.orderBy(F.desc("rank_score"), "path").limit(200)


def compact_labels(spark, sf_dir):
    """Of each file with symbols, the labels of its first twelve and of its first twelve imports."""
    files = _files(spark, sf_dir)
    first = lambda label: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line", label.alias("l")))), 1, 12), lambda x: x["l"]), "; ")
    c = F.col
    own = structure.symbols(files).groupBy("path").agg(first(T.symbol_label(c("kind"), c("name"), c("line"), c("exported"))).alias("symbols"))
    imports = _resolved(spark, sf_dir).groupBy("path").agg(first(T.place_label(c("line"), c("resolved_path"), c("specifier"))).alias("imports"))
    return own.join(imports, "path", "left")


QUERIES = {f.__name__: f for f in (compact_labels, classify_role, role_counts, extract_symbols, extract_dependencies, href_dependencies, resolve_dependencies, imported_by, graph_degree, related_files, related_graph_bfs, rerank)}

_ROLE = r"CASE WHEN regexp_matches(lower({p}), '(^|/)(test|tests|__tests__|spec|specs)(/|$)|\.(test|spec)\.[^.]+$') THEN 'test' WHEN regexp_matches(lower({p}), '(^|/)(__mocks__|mocks?)(/|$)|\bmock\b') THEN 'mock' WHEN regexp_matches(lower({p}), '(^|/)(fixtures?|samples?)(/|$)') THEN 'fixture' WHEN regexp_matches(lower({p}), '\.generated\.|\.gen\.|/generated/|/dist/|/build/') THEN 'generated' WHEN regexp_matches(lower({p}), '\.(md|mdx|rst|txt)$|(^|/)docs?/') THEN 'docs' ELSE 'source' END"
_FILES = """WITH RECURSIVE f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/f' || doc_id || '.ts' WHEN 1 THEN 'src/f' || doc_id || '.test.ts' WHEN 2 THEN 'docs/f' || doc_id || '.md' WHEN 3 THEN 'lib/generated/f' || doc_id || '.py' WHEN 4 THEN 'src/fixtures/f' || doc_id || '.ts' ELSE 'src/core/f' || doc_id || '.rs' END AS path,
  'import { x } from ''./f' || (doc_id - doc_id % 6 + 6) || ''';' || chr(10) || 'import y from "../src/f' || (doc_id - doc_id % 6 + 12) || '.js";' || chr(10) || 'export function run_' || doc_id || '() {}' || chr(10) || 'class Model' || doc_id || ' {' || chr(10) || '  let v = require(''./none'');' || chr(10) || coalesce(text, '') AS text FROM documents),
l AS (SELECT path, unnest(string_split_regex(text, '\\r?\\n')) AS c, CAST(generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS BIGINT) AS line FROM f)"""


def _symbol_sql() -> str:
    arms = lambda pick: " ".join(f"WHEN regexp_matches(c, '{p}') THEN {pick(k, p, n, e)}" for k, p, n, e in structure.SYMBOLS)
    kind = arms(lambda k, p, n, e: f"'{k}'")
    name = arms(lambda k, p, n, e: f"regexp_extract(c, '{p}', {n})")
    exported = arms(lambda k, p, n, e: "false" if e is None else r"regexp_matches(c, '\bpub\b')" if e == "pub" else f"regexp_extract(c, '{p}', {e}) <> ''")
    return f"s AS (SELECT path, CASE {name} END AS name, CASE {kind} END AS kind, line, substr(regexp_replace(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 240) AS signature, CASE {exported} END AS exported FROM l)"


def _dependency_sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    arm = lambda fam: "list_concat(" + ", ".join(f"regexp_extract_all(c, {q(p)}, 1)" for p in structure.IMPORTS[fam]) + ")"
    body = f"CASE WHEN path LIKE '%.py' THEN {arm('py')} WHEN path LIKE '%.rs' THEN {arm('rs')} WHEN path LIKE '%.go' THEN {arm('go')} ELSE {arm('js')} END"
    return f"""d AS (SELECT DISTINCT path, trim(unnest({body})) AS specifier, line FROM l),
n AS (SELECT DISTINCT path, specifier, CASE WHEN specifier LIKE './%' THEN regexp_replace(path, '[^/]*$', '') || substr(specifier, 3) WHEN specifier LIKE '../%' THEN regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]*/$', '') || substr(specifier, 4) END AS n FROM d WHERE specifier LIKE '.%'),
t AS (SELECT path, specifier, unnest([{', '.join(f"{'r' if '{r}' in x else 'n'} || '{x[3:]}'" for x in structure.TARGETS)}]) AS candidate, unnest(range({len(structure.TARGETS)})) AS at_ FROM (SELECT *, regexp_replace(n, '\\.(?:js|jsx|mjs|cjs)$', '') AS r FROM n)),
g AS (SELECT t.path, specifier, min_by(candidate, at_) AS resolved_path FROM t JOIN f ON f.path = candidate GROUP BY t.path, specifier),
r AS (SELECT d.path, d.specifier, d.line, g.resolved_path FROM d LEFT JOIN g ON g.path = d.path AND g.specifier = d.specifier)"""


_ALL = f"{_FILES}, {_symbol_sql()}, {_dependency_sql()}, deg AS (SELECT f.path, (SELECT count(*) FROM r WHERE r.path = f.path) AS n_imports, (SELECT count(*) FROM r WHERE r.resolved_path = f.path) AS n_imported_by FROM f)"
_PRIORITY = lambda p: "list_position(['source', 'docs', 'test', 'mock', 'fixture', 'generated'], " + _ROLE.format(p=p) + ") - 1"


def _bfs_sql(depth: int, most: int, each: int) -> str:
    parts = [f"""{_ALL}, e0 AS (SELECT path, 1 AS dir, specifier AS item, line, resolved_path AS target, row_number() OVER (PARTITION BY path ORDER BY line, specifier) AS p FROM r),
e1 AS (SELECT resolved_path AS path, 2 AS dir, path AS item, line, path AS target, row_number() OVER (PARTITION BY resolved_path ORDER BY path, line, path) AS p FROM r WHERE resolved_path IS NOT NULL),
e AS (SELECT path, target, p FROM e0 WHERE p <= {each} AND target IS NOT NULL UNION ALL SELECT path, target, p + {each} FROM e1 WHERE p <= {each}),
b0 AS (SELECT path, 0 AS depth, CAST(NULL AS VARCHAR) AS via, row_number() OVER (ORDER BY {_PRIORITY('path')}, doc_id, path) AS position FROM f WHERE doc_id IN {SEEDS})"""]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT path FROM b{i}" for i in range(d))
        parts.append(f"""c{d} AS (SELECT e.target AS path, min_by(b.path, b.position * 1000 + e.p) AS via, min(b.position * 1000 + e.p) AS way FROM b{d - 1} b JOIN e ON e.path = b.path WHERE e.target NOT IN ({seen}) GROUP BY e.target),
b{d} AS (SELECT * FROM (SELECT path, {d} AS depth, via, (SELECT count(*) FROM ({seen})) + row_number() OVER (ORDER BY {_PRIORITY('path')}, way, path) AS position FROM c{d}) WHERE position <= {most})""")
    return ", ".join(parts) + " SELECT path, CAST(depth AS INTEGER) AS depth, via, CAST(position AS INTEGER) AS position FROM (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(depth + 1)) + ")"


_RERANK = f"""{_ALL}, sy AS (SELECT path, list_slice(list(name ORDER BY line, name), 1, 80) AS names FROM s WHERE kind IS NOT NULL GROUP BY path),
w AS (SELECT path, flatten(list_transform(names, lambda x: list_concat([lower(x)], list_filter(list_transform(string_split_regex(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda p: lower(p)), lambda p: length(p) >= 2)))) AS words FROM sy),
k AS (SELECT f.path, doc_id % 17 / 10 AS base, lower(CASE WHEN length(regexp_replace(text, '\\s+$', '')) > 400 THEN substr(text, 1, 397) || '...' ELSE regexp_replace(text, '\\s+$', '') END) AS snip, words, n_imports, n_imported_by, {_ROLE.format(p='f.path')} AS role FROM f JOIN w USING (path) JOIN deg USING (path))
SELECT path, round(base + least(2.5, {' + '.join(f"CASE WHEN contains(lower(path), '{t}') THEN 0.25 ELSE 0 END + CASE WHEN contains(regexp_extract(lower(path), '([^/]*)$', 1), '{t}') THEN 0.2 ELSE 0 END" for t in TERMS)})
  + least(0.8, {' + '.join(f"CASE WHEN contains(snip, '{t}') THEN 0.08 ELSE 0 END" for t in TERMS)})
  + least(2.2, {' + '.join(f"CASE WHEN list_contains(words, '{t}') THEN 0.7 WHEN len(list_filter(words, lambda x: contains(x, '{t}'))) > 0 THEN 0.25 ELSE 0 END" for t in TERMS)})
  + CASE role WHEN 'generated' THEN -2.0 WHEN 'test' THEN -0.85 WHEN 'docs' THEN -0.8 WHEN 'source' THEN 0.65 ELSE -0.25 END + least(0.5, 0.04 * n_imports + 0.08 * n_imported_by), 6)::DOUBLE AS rank_score FROM k ORDER BY rank_score DESC, path LIMIT 200"""
ORACLES = {
    "classify_role": f"{_FILES} SELECT doc_id, path, {_ROLE.format(p='path')} AS role, CAST({_PRIORITY('path')} AS BIGINT) AS priority FROM f",
    "role_counts": f"WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '/docs/a.md' WHEN 1 THEN '/src/b.test.ts' ELSE '' END AS path FROM pages) SELECT {_ROLE.format(p='path')} AS role, count(*) AS n FROM p GROUP BY 1",
    "compact_labels": f"""{_ALL}, a AS (SELECT path, kind || ' ' || name || ':' || line || CASE WHEN exported THEN ' export' ELSE '' END AS label, line FROM s WHERE kind IS NOT NULL),
i AS (SELECT path, coalesce(resolved_path, specifier) || ':' || line AS label, line FROM r WHERE specifier <> '')
SELECT path, symbols, imports FROM (SELECT path, array_to_string(list_slice(list(label ORDER BY line, label), 1, 12), '; ') AS symbols FROM a GROUP BY path) LEFT JOIN (SELECT path, array_to_string(list_slice(list(label ORDER BY line, label), 1, 12), '; ') AS imports FROM i GROUP BY path) USING (path)""",
    "extract_symbols": f"{_FILES}, {_symbol_sql()} SELECT * FROM s WHERE kind IS NOT NULL",
    "extract_dependencies": f"{_FILES}, {_dependency_sql()} SELECT * FROM d WHERE specifier <> ''",
    "href_dependencies": "WITH h AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS target FROM pages) SELECT target, count(*) AS pages, min(page_id) AS first_page FROM h GROUP BY target",
    "resolve_dependencies": f"{_FILES}, {_dependency_sql()} SELECT * FROM r WHERE specifier <> ''",
    "imported_by": f"{_FILES}, {_dependency_sql()} SELECT resolved_path, count(*) AS n, min(path) AS first_path FROM r WHERE resolved_path IS NOT NULL GROUP BY 1",
    "graph_degree": f"{_ALL} SELECT * FROM deg",
    "related_files": f"{_ALL}, u AS (SELECT path, 'symbol' AS kind, name AS item, line, CAST(NULL AS VARCHAR) AS o FROM s WHERE kind IS NOT NULL UNION ALL SELECT path, 'import', specifier, line, CAST(NULL AS VARCHAR) FROM r UNION ALL SELECT resolved_path, 'imported_by', path, line, path FROM r WHERE resolved_path IS NOT NULL) SELECT * FROM (SELECT path, kind, item, line, row_number() OVER (PARTITION BY path, kind ORDER BY o, line, item) AS at FROM u) WHERE at <= 2".replace(" AS at FROM", ' AS "at" FROM').replace("WHERE at <=", 'WHERE "at" <='),
    "related_graph_bfs": _bfs_sql(3, 40, 16),
    "rerank": _RERANK,
}
