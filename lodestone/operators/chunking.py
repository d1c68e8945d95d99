"""Cut texts into overlapping chunks at line ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 512 * 1024
    target: int = 4000
    overlap: int = 400
    most: int | None = 80  #: None: all of a text
    reach: int = 240  #: how far past the target a line end may be

    def __post_init__(self):
        if self.file_bytes <= 0 or self.target <= 0 or (self.most is not None and self.most <= 0) or self.overlap < 0:
            raise ValueError("limits must be positive")


def chunks(text: str, limits: Limits = Limits()) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of each chunk; what lies beyond `most` chunks is left out, nothing if that is None.

    A chunk ends `target` characters on, or behind the line end that comes within `reach` of there. The next one starts
    at the first line that begins inside the overlap, or with the overlap itself if none does.
    """
    if not text:
        yield 1, 1, ""
        return
    at, line, made = 0, 1, 0
    while at < len(text) and (limits.most is None or made < limits.most):
        end = min(len(text), at + limits.target)
        if end < len(text):
            stop = text.find("\n", end, end + limits.reach + 1)
            end = stop + 1 if stop >= 0 else end
        part = text[at:end]
        span = max(1, part.count("\n") + (not part.endswith("\n")))
        yield line, line + span - 1, part
        made += 1
        if end >= len(text):
            return
        if limits.overlap:
            back = max(at, end - limits.overlap)
            begin = text.find("\n", back, end) + 1
            nxt = begin if 0 < begin < end else back if begin == 0 else end
            if nxt <= at:
                nxt = end
        else:
            nxt = end
        line += text.count("\n", at, nxt)
        at = nxt


def chunk_files(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """path, ordinal, start_line, end_line, text, hash of the chunks of rows of path, text. A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ordinal", "start_line", "end_line", "text", "hash"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows, held = [], 0
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
                for i, (a, b, part) in enumerate(chunks(text or "", limits)):
                    rows.append((path, i, a, b, part, hashlib.sha256(f"{path}\n{a}\n{b}\n{part}".encode()).hexdigest()))
                    held += len(part)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.select("path", F.col("text").cast("string").alias("text")).mapInArrow(run, "path string, ordinal int, start_line int, end_line int, text string, hash string")


def chunk_stats(chunks_: DataFrame) -> DataFrame:
    """One row: files, chunks, characters."""
    return chunks_.agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
