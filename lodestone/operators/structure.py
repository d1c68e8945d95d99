"""Symbols and dependencies of source files by line patterns, and resolution of relative imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (kind, pattern, group of the name, group that marks an export; "pub" for the word itself, None for never).
SYMBOLS = [
    ("function", r"^(\s*export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\b", 2, 1),
    ("class", r"^(\s*export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)\b", 2, 1),
    ("interface", r"^(\s*export\s+)?interface\s+([A-Za-z_$][\w$]*)\b", 2, 1),
    ("type", r"^(\s*export\s+)?type\s+([A-Za-z_$][\w$]*)\b", 2, 1),
    ("enum", r"^(\s*export\s+)?enum\s+([A-Za-z_$][\w$]*)\b", 2, 1),
    ("const", r"^(\s*export\s+)?const\s+([A-Za-z_$][\w$]*)\b", 2, 1),
    ("variable", r"^\s*(?:let|var)\s+([A-Za-z_$][\w$]*)\b", 1, None),
    ("function", r"^\s*def\s+([A-Za-z_]\w*)\b", 1, None),
    ("class", r"^\s*class\s+([A-Za-z_]\w*)\b", 1, None),
    ("function", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\b", 1, None),
    ("type", r"^\s*type\s+([A-Za-z_]\w*)\b", 1, None),
    ("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\b", 1, "pub"),
    ("struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)\b", 1, "pub"),
    ("enum", r"^\s*(?:pub\s+)?enum\s+([A-Za-z_]\w*)\b", 1, "pub"),
    ("trait", r"^\s*(?:pub\s+)?trait\s+([A-Za-z_]\w*)\b", 1, "pub"),
    ("module", r"^\s*(?:pub\s+)?mod\s+([A-Za-z_]\w*)\b", 1, "pub"),
]
#: Import patterns by family, and the file extensions of a family; all other files count as js.
IMPORTS = {
    "js": [r"""\bimport\s+(?:[^'"`]+\s+from\s+)?["'`]([^"'`]+)["'`]""", r"""\bexport\s+[^"'`]+\s+from\s+["'`]([^"'`]+)["'`]""", r"""\brequire\(\s*["'`]([^"'`]+)["'`]\s*\)"""],
    "py": [r"\bfrom\s+([A-Za-z_][\w.]+)\s+import\b", r"^\s*import\s+([A-Za-z_][\w.]+)"],
    "rs": [r"^\s*use\s+([^;]+);", r"^\s*mod\s+([A-Za-z_]\w*)\s*;"],
    "go": [r"""^\s*import\s+["`]([^"`]+)["`]""", r"""^\s*["`]([^"`]+)["`]"""],
}
SIGNATURE = 240
#: What a relative import may stand for, in the order tried; {n} the path, {r} without a run-time extension.
TARGETS = ["{n}", "{r}", "{r}.ts", "{r}.tsx", "{r}.mts", "{r}.cts", "{n}.ts", "{n}.tsx", "{n}.js", "{n}.jsx", "{n}.mjs", "{n}.cjs", "{n}.py", "{n}/index.ts", "{n}/index.tsx", "{n}/index.js", "{n}/index.jsx"]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), content of every line."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "content")).select("path", (F.col("at") + 1).alias("line"), "content")


def symbols(files: DataFrame) -> DataFrame:
    """path, name, kind, line, signature, exported: on each line the first pattern that fits."""
    return symbols_of_lines(lines(files))


def symbols_of_lines(rows: DataFrame) -> DataFrame:
    """The symbols of rows of path, line, content; a row with a symbol of its `own`, where that column is there, keeps it."""
    text = F.col("content")
    found = F.lit(None).cast("struct<kind:string,name:string,exported:boolean>")
    for kind, pattern, name, exported in reversed(SYMBOLS):
        mark = F.lit(False) if exported is None else text.rlike(r"\bpub\b") if exported == "pub" else F.length(F.regexp_extract(text, pattern, exported)) > 0
        found = F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, pattern, name).alias("name"), mark.alias("exported"))).otherwise(found)
    signature = F.substring(F.regexp_replace(stripped(text), r"\s+", " "), 1, SIGNATURE)
    if "own" in rows.columns:
        own = F.col("own")
        found = F.when(own.isNotNull(), F.struct(own["kind"].alias("kind"), own["name"].alias("name"), own["exported"].alias("exported"))).otherwise(found)
        signature = F.coalesce(own["signature"], signature)
    rows = rows.withColumn("found", found).where("found IS NOT NULL")
    return rows.select("path", "found.name", "found.kind", "line", signature.alias("signature"), "found.exported")


def family(path: Column) -> Column:
    return F.when(path.rlike(r"\.py$"), "py").when(path.rlike(r"\.rs$"), "rs").when(path.rlike(r"\.go$"), "go").otherwise("js")


def specifiers(path: Column, text: Column) -> Column:
    """What a line of the file imports, each once."""
    specs = F.array().cast("array<string>")
    for name, patterns in IMPORTS.items():
        all_ = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
        specs = F.when(family(path) == name, all_).otherwise(specs)
    return F.array_distinct(F.filter(F.transform(specs, stripped), lambda s: s != ""))


def dependencies(files: DataFrame) -> DataFrame:
    """path, specifier, line: every import, once a line."""
    return lines(files).select("path", "line", F.explode(specifiers(F.col("path"), F.col("content"))).alias("specifier")).select("path", "specifier", "line")


def joined_path(base: Column, relative: Column) -> Column:
    """A relative specifier from a file's folder, read as a URL's path.

    What follows "?" or "#" goes, a backslash is a slash; "." and ".." are worked off, and what climbs over the root stays
    there; a slash at the end stays, where "." or ".." stand last too; blanks, quotes, angle and curly brackets, "^", "`"
    and signs beyond ASCII are percent-encoded; slashes in front go.
    """
    folder = F.regexp_extract(base, "^(.*)/[^/]*$", 1)
    own = F.regexp_replace(F.regexp_replace(relative, r"[?#][\s\S]*$", ""), r"\\\\", "/")
    parts = F.split(F.concat(F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/"))), own), "/", -1)
    none = F.array().cast("array<string>")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    step = lambda a, p: F.when(p == ".", a).when(p == "..", up(a)).otherwise(F.concat(a, F.array(p)))
    walked = F.aggregate(parts, none, step)
    last = F.element_at(parts, -1)
    path = F.concat(F.array_join(walked, "/"), F.when(last.isin(".", "..") & (F.size(walked) > 0), F.lit("/")).otherwise(""))
    odd = F.regexp_replace(F.url_encode(path), r"\+", "%20")
    for sign in "/!$&'()*+,;=:@[]|~\\%":  # what a URL's path leaves as it is
        odd = F.replace(odd, F.lit("%" + format(ord(sign), "02X")), F.lit(sign))
    return F.regexp_replace(F.when(path.rlike(r"[^!#-;=?-\]_a-z|~]"), odd).otherwise(path), "^/+", "")


def resolve(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Adds resolved_path to dependencies: the first of a relative specifier's candidates that is a file, else null."""
    relative = deps.select("path", "specifier").distinct().where(F.startswith("specifier", F.lit(".")))
    n = relative.withColumn("n", joined_path(F.col("path"), F.col("specifier"))).withColumn("r", F.regexp_replace("n", r"\.(?:js|jsx|mjs|cjs)$", ""))
    tries = F.array(*[F.concat(F.col("r" if "{r}" in t else "n"), F.lit(t[3:])) for t in TARGETS])
    tried = n.select("path", "specifier", F.posexplode(tries).alias("at", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path", "specifier").agg(F.min_by("candidate", "at").alias("resolved_path"))
    return deps.join(found, ["path", "specifier"], "left").select("path", "specifier", "line", "resolved_path")
