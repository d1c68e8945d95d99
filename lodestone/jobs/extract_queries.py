"""Queries of the extractor plug-in, on modules derived from the documents: some it reads, some it must refuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, extract
from .code_queries import _dependency_sql, _symbol_sql
from .common import table

LIMITS = chunking.Limits(target=2000, overlap=0, most=None)
CODE = """import {
  first,
  type Second
} from "./m{a}";
export { helper } from './m{b}';
export async function run_{n}() { const inner = require("./inner"); return inner; }
interface Shape_{n} { area: number }
const left_{n} = [1, 2], right_{n} = (a, b) => a / b;
"""


def _modules(spark, sf_dir):
    """doc_id, path, text: a text as a comment or a template of a module, behind lines of Python, and behind a string without
    an end."""
    d, n, text = table(spark, sf_dir, "documents"), F.col("doc_id"), F.coalesce("text", F.lit(""))
    name, code = n.cast("string"), F.lit(CODE)
    for mark, value in (("{n}", name), ("{a}", (n + 4).cast("string")), ("{b}", (n % 7).cast("string"))):
        code = F.replace(code, F.lit(mark), value)
    path = F.when(n % 4 == 0, F.concat(F.lit("src/m"), name, F.lit(".ts"))).when(n % 4 == 1, F.concat(F.lit("src/m"), name, F.lit(".js"))).when(n % 4 == 2, F.concat(F.lit("lib/m"), name, F.lit(".py"))).otherwise(F.concat(F.lit("src/broken"), name, F.lit(".ts")))
    body = (
        F.when(n % 4 == 0, F.concat(F.lit("/* "), F.replace(text, F.lit("*/"), F.lit("* /")), F.lit(" */\n"), code))
        .when(n % 4 == 1, F.concat(code, F.lit("export const body = `"), F.translate(text, "\\`$", "   "), F.lit("`;\n")))
        .when(n % 4 == 2, F.concat(F.lit("from os import path\nclass P"), name, F.lit(":\n"), text))
        .otherwise(F.concat(F.lit("import { x } from './f"), name, F.lit("';\nconst broken = \"\n"), text))
    )
    return d.select("doc_id", path.alias("path"), body.alias("text"))


def _found(spark, sf_dir):
    return extract.extracted(_modules(spark, sf_dir), "lexer")


def lexed_symbols(spark, sf_dir):
    return extract.symbols(_found(spark, sf_dir)).withColumn("line", F.col("line").cast("long"))


def lexed_dependencies(spark, sf_dir):
    return extract.dependencies(_found(spark, sf_dir)).withColumn("line", F.col("line").cast("long"))


def extractor_reasons(spark, sf_dir):
    return extract.reasons(_found(spark, sf_dir)).withColumn("reason", F.coalesce("reason", F.lit("none")))


def declaration_chunks(spark, sf_dir):
    """What the chunks of each module cover together."""
    rows = extract.chunk_files(_modules(spark, sf_dir), "lexer", LIMITS).groupBy("path")
    return rows.agg(F.sum(F.length("text")).alias("chars"), F.min("start_line").cast("long").alias("first_line"), F.max("end_line").cast("long").alias("last_line"))


QUERIES = {f.__name__: f for f in (lexed_symbols, lexed_dependencies, extractor_reasons, declaration_chunks)}

_CODE = "'" + CODE.replace("'", "''").replace("{n}", "' || doc_id || '").replace("{a}", "' || doc_id + 4 || '").replace("{b}", "' || doc_id % 7 || '") + "'"
_MODULES = f"""WITH RECURSIVE b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'src/m' || doc_id || '.ts' WHEN 1 THEN 'src/m' || doc_id || '.js' WHEN 2 THEN 'lib/m' || doc_id || '.py' ELSE 'src/broken' || doc_id || '.ts' END AS path,
  CASE doc_id % 4 WHEN 0 THEN '/* ' || replace(t, '*/', '* /') || ' */' || chr(10) || {_CODE} WHEN 1 THEN {_CODE} || 'export const body = `' || translate(t, '\\`$', '   ') || '`;' || chr(10)
  WHEN 2 THEN 'from os import path' || chr(10) || 'class P' || doc_id || ':' || chr(10) || t ELSE 'import {{ x }} from ''./f' || doc_id || ''';' || chr(10) || 'const broken = "' || chr(10) || t END AS text FROM b),
x AS (SELECT *, CASE WHEN doc_id % 4 = 2 THEN 'unsupported_language' WHEN length(text) > 2000000 THEN 'too_large' WHEN doc_id % 4 = 3 THEN 'parse_error' END AS reason FROM m),
o AS (SELECT doc_id, path, text, CASE WHEN doc_id % 4 = 0 THEN length(text) - length(replace(text, chr(10), '')) - 8 ELSE 0 END AS up FROM x WHERE reason IS NULL),
f AS (SELECT path, text FROM x WHERE reason IS NOT NULL),
l AS (SELECT path, unnest(string_split_regex(text, '\\r?\\n')) AS c, CAST(generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS BIGINT) AS line FROM f)"""
_ORDINARY = "const left_' || doc_id || ' = [1, 2], right_' || doc_id || ' = (a, b) => a / b;"
ORACLES = {
    "lexed_symbols": f"""{_MODULES}, {_symbol_sql()} SELECT path, name, kind, line, signature, exported FROM s WHERE kind IS NOT NULL
UNION ALL SELECT path, 'run_' || doc_id, 'function', up + 6, 'async function run_' || doc_id || '() {{ const inner = require("./inner"); return inner; }}', true FROM o
UNION ALL SELECT path, 'Shape_' || doc_id, 'interface', up + 7, 'interface Shape_' || doc_id || ' {{ area: number }}', false FROM o
UNION ALL SELECT path, unnest(['left_' || doc_id, 'right_' || doc_id]), 'const', up + 8, '{_ORDINARY}', false FROM o
UNION ALL SELECT path, 'body', 'const', 9, substr(rtrim(regexp_replace(substr(text, strpos(text, 'const body = `')), '\\s+', ' ', 'g')), 1, 240), true FROM o WHERE doc_id % 4 = 1""",
    "lexed_dependencies": f"""{_MODULES}, {_dependency_sql()} SELECT path, specifier, line FROM d WHERE specifier <> ''
UNION ALL SELECT path, './m' || doc_id + 4, up + 4 FROM o UNION ALL SELECT path, './m' || doc_id % 7, up + 5 FROM o UNION ALL SELECT path, './inner', up + 6 FROM o""",
    "extractor_reasons": f"{_MODULES} SELECT coalesce(reason, 'none') AS reason, count(*) AS files FROM x GROUP BY 1",
    "declaration_chunks": f"{_MODULES} SELECT path, CAST(length(text) AS BIGINT) AS chars, CAST(1 AS BIGINT) AS first_line, CAST(greatest(1, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END) AS BIGINT) AS last_line FROM x",
}
