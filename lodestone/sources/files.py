"""Files of a project tree as rows: a Python data source, and code-like files derived from the document table."""

from __future__ import annotations

import codecs
import fnmatch
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What is never indexed. All of them bind at the root of the project.
IGNORED_FOLDERS = [".git", "node_modules", "dist", "build", ".next", ".turbo", "coverage"]
IGNORED_FILES = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.webp", "*.ico", "*.pdf", "*.zip", "*.gz", "*.tar", "*.7z", "*.woff", "*.woff2", "*.ttf"]
HEAD = 8192


def is_binary(head: bytes) -> bool:
    """Whether the first bytes of a file are no text: a NUL, or no UTF-8; a character cut at the end is none of that."""
    if b"\0" in head:
        return True
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=False)
    except UnicodeDecodeError:
        return True
    return False


#: Parts of an ignore pattern: folders of any depth, an escaped sign, wildcards, a class of signs, and any other sign.
GLOB = re.compile(r"(?P<deep>(?:^|(?<=/))\*\*/)|(?P<rest>(?<=/)\*\*$)|\\(?P<sign>.)|(?P<any>\*+)|(?P<one>\?)|\[(?P<not>[!^]?)(?P<set>\]?[^\]]*)\]|(?P<own>.)", re.S)


def glob_regex(pattern: str) -> str:
    """A pattern as a regular expression of a path: "*" and "?" stay within a folder, "**" does not."""

    def part(m: re.Match) -> str:
        if m["deep"]:
            return "(?:.*/)?"
        if m["rest"]:
            return ".+"
        if m["any"]:
            return "[^/]*"
        if m["one"]:
            return "[^/]"
        if m["set"]:
            return "(?!/)[" + ("^" if m["not"] else "") + re.sub(r"([\[\]&~|^])", r"\\\1", m["set"]) + "]"
        return re.escape(m["sign"] or m["own"] or m[0])

    return GLOB.sub(part, pattern)


def ignore_rules(root: str) -> list[tuple[bool, bool, str]]:
    """(keeps, folders only, regular expression) of each rule in the root's .gitignore; none if there is no such file.

    "#" starts a comment, "!" a rule that keeps, unless a backslash stands before; blanks at the end go unless escaped. A
    pattern with a slash before its end binds at the root, any other fits at every depth. Case does not matter.
    """
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            rows = f.read().splitlines()
    except FileNotFoundError:
        return []
    out = []
    for row in rows:
        row = re.sub(r"(?<!\\)\s+$", "", row)
        keeps = row.startswith("!")
        pattern = row[1:] if keeps else row
        if not pattern.strip("/") or row.startswith("#"):
            continue
        bound = "/" in pattern[:-1]
        out.append((keeps, pattern.endswith("/"), ("" if bound else "(?:.*/)?") + glob_regex(pattern.strip("/"))))
    return out


def ignored(path: str, rules: list[tuple[bool, bool, str]]) -> bool:
    """Whether the last rule that fits a file ignores it, or one of its folders, below which nothing is kept again."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        at, folder, out = "/".join(parts[:i]), i < len(parts), False
        for keeps, folders, pattern in rules:
            if (folder or not folders) and re.fullmatch(pattern, at, re.I | re.S):
                out = not keeps
        if out:
            return True
    return False


class ProjectFiles(DataSource):
    """spark.read.format("project_files").option("max_bytes", ...).load(root): path, size, mtime, text, reason, detail.

    Every file comes once, with its text or with the reason why it was skipped; a file that cannot be read is no error.
    The tree is listed on the driver and its files are read by the tasks, `files_a_task` in each, so the root must be a
    folder that all of them see.
    """

    @classmethod
    def name(cls) -> str:
        return "project_files"

    def schema(self) -> str:
        return "path string, size bigint, mtime double, text string, reason string, detail string"

    def reader(self, schema) -> DataSourceReader:
        return ProjectReader(self.options)


class Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ProjectReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.most, self.each = int(options.get("max_bytes", 512 * 1024)), int(options.get("files_a_task", 500))
        self.rules = ignore_rules(self.root)

    def partitions(self) -> list[Part]:
        found = []
        for folder, folders, names in os.walk(self.root):
            at = os.path.relpath(folder, self.root)
            folders[:] = [f for f in folders if not (at == "." and f in IGNORED_FOLDERS)]
            found += [os.path.normpath(os.path.join(at, n)).replace(os.sep, "/") for n in names if not (at == "." and any(fnmatch.fnmatchcase(n, p) for p in IGNORED_FILES))]
        found.sort()
        return [Part(found[i : i + self.each]) for i in range(0, len(found), self.each)]

    def read(self, part: Part) -> Iterator[tuple]:
        for path in part.paths:
            yield self.row(path)

    def row(self, path: str) -> tuple:
        full = os.path.join(self.root, path)
        try:
            if ignored(path, self.rules):
                return path, None, None, None, "ignored", None
            if not os.path.realpath(full).startswith(os.path.realpath(self.root) + os.sep):
                return path, None, None, None, "outside_project", None
            if os.path.islink(full) or not os.path.isfile(full):
                return path, None, None, None, "not_file", None
            stat = os.stat(full)
            if stat.st_size > self.most:
                return path, stat.st_size, stat.st_mtime, None, "too_large", f"{stat.st_size} bytes > {self.most} bytes"
            with open(full, "rb") as f:
                data = f.read()
            if is_binary(data[:HEAD]):
                return path, stat.st_size, stat.st_mtime, None, "binary", None
            return path, stat.st_size, stat.st_mtime, data.decode("utf-8", "replace"), None, None
        except OSError as e:
            return path, None, None, None, "read_error", str(e)


def derived_files(documents: DataFrame) -> DataFrame:
    """Documents as source files that import each other: doc_id, path, text."""
    n = F.col("doc_id")
    name = F.concat(F.lit("f"), n.cast("string"))
    path = (
        F.when(n % 6 == 0, F.concat(F.lit("src/"), name, F.lit(".ts")))
        .when(n % 6 == 1, F.concat(F.lit("src/"), name, F.lit(".test.ts")))
        .when(n % 6 == 2, F.concat(F.lit("docs/"), name, F.lit(".md")))
        .when(n % 6 == 3, F.concat(F.lit("lib/generated/"), name, F.lit(".py")))
        .when(n % 6 == 4, F.concat(F.lit("src/fixtures/"), name, F.lit(".ts")))
        .otherwise(F.concat(F.lit("src/core/"), name, F.lit(".rs")))
    )
    a, b = (n - n % 6 + 6).cast("string"), (n - n % 6 + 12).cast("string")
    head = F.concat(F.lit("import { x } from './f"), a, F.lit("';\nimport y from \"../src/f"), b, F.lit(".js\";\nexport function run_"), n.cast("string"), F.lit("() {}\nclass Model"), n.cast("string"), F.lit(" {\n  let v = require('./none');\n"))
    return documents.select("doc_id", path.alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProjectFiles)
