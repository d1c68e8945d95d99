"""Symbols, dependencies and chunks by an extractor that is chosen by name; files that it refuses go by line patterns.

An extractor reads one file at a time inside of the tasks. A file that it does not know, cannot read or fails on is never lost:
its text goes on to the patterns of `structure` in the same pass, and the reason is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunking, lexer, lines, structure

#: Why a file goes by line patterns.
MISSING, LANGUAGE, LARGE, PARSE, FAILED = "missing_extractor", "unsupported_language", "too_large", "parse_error", "extractor_failed"


@dataclass(frozen=True)
class Extractor:
    """`graph` gives a file's lexer.Graph or raises lexer.Malformed; `accepts` says which paths it knows."""

    name: str
    accepts: Callable[[str], bool]
    graph: Callable[[str, str], lexer.Graph]
    most: int = 2_000_000  #: characters of a file; what is larger goes by line patterns


PATTERNS = "patterns"  #: no extractor: line patterns for all files
EXTRACTORS: dict[str, Extractor] = {}


def register(extractor: Extractor) -> None:
    if not extractor.name or extractor.name == PATTERNS:
        raise ValueError(f"an extractor cannot be named {extractor.name!r}")
    EXTRACTORS[extractor.name] = extractor


register(Extractor("lexer", lambda path: bool(lexer.LANGUAGES.search(path)), lexer.graph))

_SYMBOL = "struct<name:string,kind:string,line:int,signature:string,exported:boolean>"
_DEPENDENCY = "struct<specifier:string,line:int>"
_SCHEMA = f"path string, text string, reason string, symbols array<{_SYMBOL}>, dependencies array<{_DEPENDENCY}>"
_ARROW = pa.schema(
    [
        ("path", pa.string()), ("text", pa.string()), ("reason", pa.string()),
        ("symbols", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("signature", pa.string()), ("exported", pa.bool_())]))),
        ("dependencies", pa.list_(pa.struct([("specifier", pa.string()), ("line", pa.int32())]))),
    ]
)


def _read(extractor: Extractor | None, path: str | None, text: str) -> tuple[str | None, lexer.Graph]:
    none = lexer.Graph([], [])
    if extractor is None:
        return MISSING, none
    try:
        if not extractor.accepts(path or ""):
            return LANGUAGE, none
        if len(text) > extractor.most:
            return LARGE, none
        return None, extractor.graph(path, text)
    except lexer.Malformed:
        return PARSE, none
    except Exception:  # whatever a plug-in fails on, its file is read by patterns and counted
        return FAILED, none


def extracted(files: DataFrame, name: str) -> DataFrame:
    """path, text, reason, symbols, dependencies of rows of path, text: text where there is a reason, else null and the graph.

    A narrow pass. A name that is not registered gives every file the reason `missing_extractor`; a null text is empty; rows
    repeat as they come; other columns are not read.
    """
    extractor = EXTRACTORS.get(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in lines.slices(b, "text")):
            rows = []
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
                reason, g = _read(extractor, path, text)
                rows.append({"path": path, "text": text if reason else None, "reason": reason, "symbols": [s._asdict() for s in g.symbols], "dependencies": [{"specifier": s, "line": n} for s, n in g.dependencies]})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    src = files.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if name == PATTERNS or extractor is None:  # nothing for Python to do
        reason = F.lit(None if name == PATTERNS else MISSING).cast("string")
        return src.select("path", "text", reason.alias("reason"), F.array().cast(f"array<{_SYMBOL}>").alias("symbols"), F.array().cast(f"array<{_DEPENDENCY}>").alias("dependencies"))
    return src.mapInArrow(run, _SCHEMA)


def symbols(found: DataFrame) -> DataFrame:
    """path, name, kind, line, signature, exported of what extracted() gave, of one pass over it."""
    own = F.transform("symbols", lambda s: F.struct(s["line"].alias("line"), F.lit(None).cast("string").alias("content"), s.alias("own")))
    return structure.symbols_of_lines(_lines(found, own, _SYMBOL))


def dependencies(found: DataFrame) -> DataFrame:
    """path, specifier, line of what extracted() gave, of one pass over it."""
    own = F.transform("dependencies", lambda d: F.struct(d["line"].alias("line"), F.lit(None).cast("string").alias("content"), d.alias("own")))
    rows = _lines(found, own, _DEPENDENCY)
    specs = F.when(F.col("own").isNotNull(), F.array("own.specifier")).otherwise(structure.specifiers(F.col("path"), F.col("content")))
    return rows.select("path", "line", F.explode(specs).alias("specifier")).select("path", "specifier", "line")


def _lines(found: DataFrame, own, kind: str) -> DataFrame:
    """path, line, content, own: a row for each line of texts that go by patterns, and for each thing found of the others."""
    at = F.transform(F.split("text", "\r?\n"), lambda c, i: F.struct((i + 1).alias("line"), c.alias("content"), F.lit(None).cast(kind).alias("own")))
    return found.select("path", F.explode(F.when(F.col("text").isNotNull(), at).otherwise(own)).alias("r")).select("path", "r.*")


def reasons(found: DataFrame) -> DataFrame:
    """reason, files: how many files went by line patterns and why, null for those that the extractor read."""
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


def pieces(text: str, borders: list[int], limits: chunking.Limits) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text): the declarations whose first lines are `borders` in chunks of up to `target` characters.

    Declarations next to each other share a chunk as long as they fit; what stands in front of the first belongs to it. One
    that is larger alone is cut as any text is. Without overlap the chunks together are the text.
    """
    rows = text.split("\n")
    starts = [0, *sorted({b - 1 for b in borders if 1 < b <= len(rows)}), len(rows)]
    held, first = "", 1
    for a, b in zip(starts, starts[1:]):
        part = "\n".join(rows[a:b]) + ("\n" if b < len(rows) else "")
        if held and len(held) + len(part) > limits.target:
            yield from _cut(held, first, limits)
            held, first = "", a + 1
        held += part
    if held or not text:
        yield from _cut(held, first, limits)


def _cut(part: str, first: int, limits: chunking.Limits) -> Iterator[tuple[int, int, str]]:
    if len(part) <= limits.target:
        yield first, first + max(0, part.count("\n") - part.endswith("\n")), part
    else:
        yield from ((first + a - 1, first + b - 1, t) for a, b, t in chunking.chunks(part, limits))


def chunk_files(files: DataFrame, name: str, limits: chunking.Limits = chunking.Limits()) -> DataFrame:
    """path, ordinal, start_line, end_line, text, reason: chunks at the borders of declarations, those of files that the
    extractor refuses as chunking.chunks cuts them. A narrow pass; `most` of the limits binds for each file."""
    extractor = EXTRACTORS.get(name)
    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in lines.slices(b, "text")):
            rows = []
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
                reason, g = _read(extractor, path, text)
                made = chunking.chunks(text, limits) if reason else pieces(text, [s.line for s in g.symbols], limits)
                for i, (a, b, part) in enumerate(made):
                    if limits.most is not None and i >= limits.most:
                        break
                    rows.append((path, i, a, b, part, reason))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    src = files.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, "path string, ordinal int, start_line int, end_line int, text string, reason string")
