"""Column functions of search terms, snippets, paths and reasons. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = "\n... [truncated]"

#: The words that tell what a query is about.
INTENT = {
    "code": ["function", "class", "type", "interface", "handler", "provider", "schema", "index", "chunk", "row", "cache", "fallback", "rerank", "search", "embedding", "sqlite", "storage", "scanner", "binary"],
    "docs": ["readme", "docs", "documentation", "codex", "wsl", "windows", "setup", "config", "npm", "publish", "security", "privacy", "policy", "remote", "committed", "commit"],
    "test": ["test", "tests", "spec", "regression", "fixture"],
    "benchmark": ["benchmark", "benchmarks", "bench", "gate", "gates", "suite", "suites", "case", "cases"],
    "manifest": ["npm", "package", "publish", "release", "dependency", "dependencies", "script", "scripts", "bin", "cli", "version", "license"],
    "ignore": ["ignore", "ignored", "secret", "secrets", "local", "commit", "committed", "privacy"],
}
#: Roles of paths with the patterns that show them, in the order in which they are tried.
ROLE_PATTERNS = {
    "test": r"(^|/)(test|tests|__tests__|spec|specs)(/|$)|\.(test|spec)\.[^.]+$",
    "mock": r"(^|/)(__mocks__|mocks?)(/|$)|\bmock\b",
    "fixture": r"(^|/)(fixtures?|samples?)(/|$)",
    "generated": r"\.generated\.|\.gen\.|/generated/|/dist/|/build/",
    "docs": r"\.(md|mdx|rst|txt)$|(^|/)docs?/",
}
#: How path roles are preferred, the first best.
ROLES = ["source", "docs", "test", "mock", "fixture", "generated"]


def keyword_terms(query: Column) -> Column:
    """Distinct words of two signs or more, in the order of their first places."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"([\p{L}\p{N}_.$/-]{2,})"), F.lit(1)))


def split_identifier(name: Column) -> Column:
    """The lower-cased words of an identifier in camel case, snake case or a path."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower)
    return F.filter(parts, lambda p: F.length(p) >= 2)


def query_terms(query: Column) -> Column:
    """Each keyword in lower case, followed by the words of its identifier; distinct."""
    each = F.transform(keyword_terms(query), lambda t: F.concat(F.array(F.lower(t)), split_identifier(t)))
    return F.filter(F.array_distinct(F.flatten(each)), lambda t: F.length(t) >= 2)


def search_terms(query: Column) -> Column:
    """Keywords that a trigram index can find."""
    return F.filter(keyword_terms(query), lambda t: F.length(t) >= 3)


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def compact_snippet(text: Column, most: int) -> Column:
    """Right-trimmed; where it is longer than `most`, cut so that dots fit in."""
    t = trim_end(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def truncate_text(text: Column, most: int) -> Column:
    cut = F.concat(trim_end(F.substring(text, 1, max(0, most - len(TRUNCATED)))), F.lit(TRUNCATED))
    return F.when(F.length(text) > most, cut).otherwise(text)


def fit_budget(text: Column, left: Column) -> Column:
    """What of a snippet fits into `left` characters, marked where it was cut."""
    mark = len(TRUNCATED)
    bare = F.lit(TRUNCATED.lstrip("\n"))
    return F.when(F.length(text) <= left, text).when(left >= mark, F.concat(trim_end(text.substr(F.lit(1), left - mark)), F.lit(TRUNCATED))).when(left >= mark - 1, bare).otherwise("")


def estimate_tokens(chars: Column) -> Column:
    return F.ceil(F.greatest(F.lit(0), chars) / 4)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "[/._-]+"), lambda p: F.length(p) >= 3)


def grep_keywords(query: Column, path: Column) -> Column:
    """Up to eight words to look for: the query's, then the path's."""
    return F.slice(F.array_distinct(F.concat(keyword_terms(query), path_parts(path))), 1, 8)


def match_reason(kinds: Column, distance: Column, score: Column) -> Column:
    """Why a row was found, in words."""
    semantic, keyword = F.array_contains(kinds, "semantic"), F.array_contains(kinds, "keyword")
    return (
        F.when(semantic & keyword, "semantic similarity plus keyword/path match")
        .when(keyword, "keyword/path match")
        .when(F.array_contains(kinds, "local"), "local code-aware related file")
        .when(distance.isNotNull(), F.concat(F.lit("semantic similarity distance "), F.format_string("%.4f", distance)))
        .when(score.isNotNull(), F.concat(F.lit("ranked score "), F.format_string("%.4f", score)))
        .otherwise("ranked match")
    )


def classify_path(path: Column) -> Column:
    """The role of a file by its path; the first that fits."""
    role = F.lit("source")
    for name, pattern in reversed(ROLE_PATTERNS.items()):
        role = F.when(F.lower(path).rlike(pattern), name).otherwise(role)
    return role


def role_priority(role: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), role) - 1


def has_intent(terms: Column, kind: str) -> Column:
    return F.arrays_overlap(terms, F.array(*[F.lit(w) for w in INTENT[kind]]))


def role_score(path: Column, terms: list[str]) -> Column:
    """What a path's role adds to its score, given what the query's terms are about."""
    about = {k: bool(set(terms) & set(words)) for k, words in INTENT.items()}
    name, role = F.lower(F.regexp_extract(path, "([^/]*)$", 1)), classify_path(path)
    out = F.when(role == "generated", -2.0)
    out = out.when(F.startswith(path, F.lit("benchmarks/")) & F.lit(not about["benchmark"]), -0.7 if about["code"] else -0.35)
    out = out.when(role == "test", 0.4 if about["test"] else -0.85 if about["code"] else -0.25)
    out = out.when(role == "docs", 0.65 if about["docs"] else -0.8 if about["code"] else -0.15)
    out = out.when(role == "source", 0.05 if about["docs"] else 0.65 if about["code"] else 0.15).otherwise(-0.25)
    if about["ignore"]:
        out = F.when(name.isin(".gitignore", ".npmignore", ".dockerignore"), 0.9).otherwise(out)
    if about["manifest"]:
        out = F.when(name.isin("package.json", "deno.json", "jsr.json"), 1.2).otherwise(out)
    return out


def role_score_of(path: Column, terms: Column) -> Column:
    """role_score where the terms are a column of word lists."""
    about = {k: has_intent(terms, k) for k in INTENT}
    name, role = F.lower(F.regexp_extract(path, "([^/]*)$", 1)), classify_path(path)
    code = lambda yes, no: F.when(about["code"], yes).otherwise(no)
    return (
        F.when(about["manifest"] & name.isin("package.json", "deno.json", "jsr.json"), 1.2)
        .when(about["ignore"] & name.isin(".gitignore", ".npmignore", ".dockerignore"), 0.9)
        .when(role == "generated", -2.0)
        .when(F.startswith(path, F.lit("benchmarks/")) & ~about["benchmark"], code(-0.7, -0.35))
        .when(role == "test", F.when(about["test"], 0.4).otherwise(code(-0.85, -0.25)))
        .when(role == "docs", F.when(about["docs"], 0.65).otherwise(code(-0.8, -0.15)))
        .when(role == "source", F.when(about["docs"], 0.05).otherwise(code(0.65, 0.15)))
        .otherwise(-0.25)
    )


def normal_path(path: Column) -> Column:
    """Forward slashes, without a leading "./"."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def chunk_title(title: Column, path: Column, start: Column, end: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def embedding_text(kind: str, text: Column, title: Column | None = None) -> Column:
    """What is sent to an embedding provider for a query or a document."""
    if kind == "query":
        return F.concat(F.lit("task: code retrieval | query: "), text)
    return F.concat(F.lit("title: "), F.coalesce(title if title is not None else F.lit(None), F.lit("none")), F.lit(" | text: "), text)


def valid_vector(vector: Column, size: int) -> Column:
    """Whether a vector has `size` finite elements."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & ~F.coalesce(bad, F.lit(False))


def occurrences(text: Column, term: Column | str) -> Column:
    """How often a term stands in a text, overlapping occurrences included; both in one case.

    A term with no proper prefix that is its suffix cannot overlap itself; it is counted by what goes when it is removed.
    """
    if isinstance(term, str):
        if not any(term.startswith(term[i:]) for i in range(1, len(term))):
            return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")
        return F.regexp_count(text, F.lit("(?=" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in term) + ")"))
    return F.regexp_count(text, F.concat(F.lit("(?=\\Q"), term, F.lit("\\E)")))


def symbol_label(kind: Column, name: Column, line: Column, exported: Column) -> Column:
    """Kind, name, line and whether it is exported, in one short text."""
    at = F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit(""))
    mark = F.when(exported, " export").otherwise("")
    return F.concat(F.coalesce(kind, F.lit("symbol")), F.lit(" "), F.coalesce(name, F.lit("unknown")), at, mark)


def place_label(line: Column, *names: Column) -> Column:
    """The first name that is not null, and its line."""
    return F.concat(F.coalesce(*names, F.lit("unknown")), F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")))
