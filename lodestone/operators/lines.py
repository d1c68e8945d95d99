"""Line search for all cases at once: one automaton over the terms of every case reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import keyword_terms

MOST_CASES, MOST_TERMS, LEAST = 10_000, 10, 3
MOST_BYTES = 4 << 20  # of texts at a time
KIND_SHARE = 0.25  # what each term of a line adds, however often it is there


def case_terms(cases: DataFrame) -> DataFrame:
    """case_id, terms of cases (case_id, query): the first ten keywords of three letters or more, in lower case."""
    long = F.filter(keyword_terms(F.col("query")), lambda t: F.length(t) >= LEAST)
    return cases.select("case_id", F.transform(F.slice(long, 1, MOST_TERMS), F.lower).alias("terms"))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most MOST_BYTES of a column, or a single larger row: what Python makes of a piece is bounded so."""
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0)).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + MOST_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def holding(files: DataFrame, phrases: DataFrame, n: int) -> DataFrame:
    """case_id, path: the files (path, text) that hold a phrase (case_id, words) of n words, one after the other.

    Words are what stands between single blanks or line ends. A narrow pass: a text's words are looked up only where a
    phrase's first word stands. Phrases are a bounded set; those of another number of words are held by no file.
    """
    asked = phrases.limit(MOST_CASES + 1).collect()  # a bounded set
    if len(asked) > MOST_CASES:
        raise ValueError(f"more than {MOST_CASES} phrases: search them in several calls")
    cases: dict[tuple, list[int]] = {}
    for i, r in enumerate(asked):
        words = tuple(r["words"].split(" ")) if r["words"] is not None else ()
        if len(words) == n:
            cases.setdefault(words, []).append(i)
    first = {w[0] for w in cases}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                case, paths = [], []
                for path, text in zip(piece["path"].to_pylist(), piece["text"].to_pylist()):
                    w = (text or "").replace("\n", " ").split(" ")
                    held = {c for i, x in enumerate(w) if x in first for c in cases.get(tuple(w[i : i + n]), ())}
                    case += held
                    paths += [path] * len(held)
                if case:
                    yield pa.RecordBatch.from_arrays([pa.array(case, pa.int32()), pa.array(paths, pa.string())], names=["case", "path"])

    rows = files.select("path", "text").mapInArrow(run, "case int, path string")
    names = files.sparkSession.createDataFrame([(i, r["case_id"]) for i, r in enumerate(asked)], T.StructType([T.StructField("case", T.IntegerType()), phrases.schema["case_id"]]))
    return rows.join(F.broadcast(names), "case").select("case_id", "path")  # a bounded set


def search_cases(files: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, path, score, first_line of every file (path, text; each path once) that has a term of a case (case_id, query).

    Each line counts the places of each term and KIND_SHARE for each term that it has. A narrow pass: what leaves a text is a
    row for each case that it has terms of. Cases are a bounded set, whose terms make the automaton; more are refused. Null
    texts have no lines; a case without terms has no rows; a term that a case has twice, but for case, counts twice.
    """
    asked = case_terms(cases).limit(MOST_CASES + 1).collect()  # a bounded set
    if len(asked) > MOST_CASES:
        raise ValueError(f"more than {MOST_CASES} cases: search them in several calls")
    terms = sorted({t for r in asked for t in r["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    pairs = np.array([(number[t], c) for c, r in enumerate(asked) for t in r["terms"]], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for t, i in number.items():
            automaton.add_word(t, i)
        automaton.make_automaton()
        for batch in (piece for b in batches for piece in slices(b, "low")):
            out: list[tuple] = []
            for path, low in zip(batch["path"].to_pylist(), batch["low"].to_pylist()):
                found = np.array([(end, i) for end, i in automaton.iter(low)] if low and terms else [], np.int64).reshape(-1, 2)
                if not len(found):
                    continue
                breaks = np.array([i for i, c in enumerate(low) if c == "\n"], np.int64)
                line = np.searchsorted(breaks, found[:, 0]) + 1
                key, hits = np.unique(line * len(terms) + found[:, 1], return_counts=True)  # a line and a term
                line, term = key // len(terms), key % len(terms)
                size = first[term + 1] - first[term]
                case = pairs[np.repeat(first[term] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum()), 1]
                score = np.bincount(case, np.repeat(hits + KIND_SHARE, size), len(asked))
                earliest = np.full(len(asked), np.iinfo(np.int64).max)
                np.minimum.at(earliest, case, np.repeat(line, size))
                some = np.flatnonzero(score)
                out.append((some, path, score[some], earliest[some]))
            if out:
                c, p, s, f = zip(*out)
                paths = np.repeat(np.arange(len(p)), [len(x) for x in c])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int32()), pa.array(p).take(pa.array(paths)), pa.array(np.concatenate(s)), pa.array(np.concatenate(f), pa.int64())], names=["case", "path", "score", "first_line"])

    rows = files.select("path", F.lower("text").alias("low")).mapInArrow(run, "case int, path string, score double, first_line long")
    names = files.sparkSession.createDataFrame([(i, r["case_id"]) for i, r in enumerate(asked)], T.StructType([T.StructField("case", T.IntegerType()), cases.schema["case_id"]]))
    return rows.join(F.broadcast(names), "case").select("case_id", "path", "score", "first_line")  # a bounded set
