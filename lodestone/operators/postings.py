"""A keyword index that is written and then searched: compressed posting blocks of trigrams with positions.

Chunks are put in the order of their keys and numbered, and cut into shards of at most `SHARD` chunks and some `SHARD_CHARS`
characters. A block holds what one shard has of one trigram: delta-coded numbers of chunks, and delta-coded places in each,
those of the path before those of the text; and, uncoded, how many chunks and places. Texts are shuffled once, by their keys:
a task numbers its chunks, makes their blocks and writes them in the order of the trigram, so that blocks, which are larger
than texts, are neither shuffled nor made twice. A list of each file's first and last trigram is kept; a search opens the
files that may have any of its own, and of these reads the pages whose bounds allow a trigram.

A search has two passes. The first brings the blocks of the wanted trigrams together by shard. There a term's trigrams are
met one by one, the rarest first, and a block whose chunks are none of those left is not read further: a term stands where
its trigrams stand one behind the other, so texts are not looked at. What comes out are matches, and how many each term has.
The second pass scores. With the best matches of each term, the score that a query's k-th best chunk has at least is known
before; a shard whose terms together cannot reach it is skipped for that query, and of the others only the k best leave.
"""

from __future__ import annotations

import bisect
import functools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, scratch, stored

SHARD, SHARD_CHARS = 1024, 2_000_000
GRAM = 3
LENGTHS = -1  # stands for a trigram: blocks of the chunks' own lengths
SLACK = 2e-6  # scores are compared after rounding to six places

MOST_FILTERS = 64  # trigrams that are compared with the bounds of pages, one by one

_BLOCKS = "gram long, shard long, n int, n_places int, chunks binary, counts binary, places binary"


class Index(NamedTuple):
    docs: DataFrame  #: number, path, ordinal, start_line, end_line, d
    blocks: DataFrame  #: of all trigrams
    files: list  #: (first trigram, last trigram, file), by first trigram
    n: int  #: chunks
    mean: float  #: their mean length, as BM25 counts it
    path: str


# --- coding ---


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 up as bytes of seven bits, the last byte of each without its high bit; and where each ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in (7, 14, 21, 28, 35):
        size += v >= np.uint64(1 << bits)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[end[some] - size[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(size[some] > k + 1, 128, 0).astype(np.uint64)
    return out, end


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """values, coded, as a binary for each range between edges."""
    data, end = coded(values)
    at = np.append(0, end)[edges]
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def decoded(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.append(0, last[:-1] + 1)
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        some = np.flatnonzero(first + k <= last)
        out[some] |= (b[first[some] + k].astype(np.int64) & 127) << (7 * k)
    return out


def gram_code(a, b, c):
    return a << 42 | b << 21 | c


def gram_codes(term: str) -> list[int]:
    p = [ord(x) for x in term]
    return [gram_code(*p[i : i + GRAM]) for i in range(len(p) - GRAM + 1)]


# --- building ---


def _numbered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order: shard by size, number within it."""
    seq, at, chars = 0, 0, 0
    for batch in batches:
        size = np.asarray(batch["size"])
        pid = batch["pid"].to_numpy().astype(np.int64)
        shard, number = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for i, n in enumerate(size.tolist()):
            if at and (at == most or chars + n > SHARD_CHARS):
                seq, at, chars = seq + 1, 0, 0
            shard[i], number[i] = seq, at
            at, chars = at + 1, chars + n
        shard += pid << 24
        keep = [c for c in batch.schema.names if c not in ("pid", "size")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(shard), pa.array(shard << 12 | number)], names=[*keep, "shard", "number"])


def _shard_blocks(shard: int, numbers: np.ndarray, paths: list[str], texts: list[str], docs: pa.Array) -> Iterator[pa.RecordBatch]:
    """The blocks of one shard; that of lengths has what is known of its chunks, too."""
    pieces, lengths = [], []
    for p, t in zip(paths, texts):
        a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.int64) for x in (p, t))
        lengths.append((len(a), len(b)))
        pieces += [a, np.full(GRAM, -1), b, np.full(GRAM, -1)]  # no trigram spans path and text, or two chunks
    flat = np.concatenate(pieces)
    size = np.array([a + b + 2 * GRAM for a, b in lengths])
    begin = np.append(0, np.cumsum(size))[:-1]
    ok = (flat[:-2] >= 0) & (flat[1:-1] >= 0) & (flat[2:] >= 0)
    at = np.flatnonzero(ok)
    gram = gram_code(flat[at], flat[at + 1], flat[at + 2])
    chunk = np.searchsorted(begin, at, "right") - 1
    place = at - begin[chunk]
    order = np.argsort(gram, kind="stable")  # chunks and places stay ascending
    gram, chunk, place = gram[order], chunk[order], place[order]
    new_gram = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
    new_chunk = new_gram | np.append(True, chunk[1:] != chunk[:-1])[: len(gram)]
    heads = np.flatnonzero(new_chunk)
    counts = np.diff(np.append(heads, len(gram)))
    gap = place - np.append(0, place[:-1])[: len(gram)]
    gap[heads] = place[heads]
    number = numbers[chunk[heads]] & 4095
    step = number - np.append(0, number[:-1])[: len(heads)]
    first = new_gram[heads]
    step[first] = number[first]
    edges = np.append(np.flatnonzero(first), len(heads))
    ends = np.append(heads, len(gram))[edges]
    own = np.array([0, len(numbers)])
    facts = [np.diff(np.append(0, numbers & 4095)), np.array([a for a, _ in lengths]), np.array([b for _, b in lengths])]
    names = ["gram", "shard", "n", "n_places", "chunks", "counts", "places", "docs"]
    few = pa.array(np.full(1, len(numbers)), pa.int32())
    known = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
    yield pa.RecordBatch.from_arrays([pa.array([LENGTHS], pa.int64()), pa.array([shard], pa.int64()), few, few, *[_cut(x, own) for x in facts], known], names=names)
    yield pa.RecordBatch.from_arrays([pa.array(gram[heads[edges[:-1]]] if len(gram) else gram, pa.int64()), pa.array(np.full(len(edges) - 1, shard), pa.int64()), pa.array(np.diff(edges), pa.int32()), pa.array(np.diff(ends), pa.int32()), _cut(step, edges), _cut(counts, edges), _cut(gap, ends), pa.nulls(len(edges) - 1, known.type)], names=names)


def _blocks(batches: Iterator[pa.RecordBatch], known: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of each run of rows of one shard, whose columns `known` are kept."""
    now, held = None, []

    def made() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        docs = pa.StructArray.from_arrays([rows[c] for c in known], names=known)
        return _shard_blocks(now, rows["number"].to_numpy(), rows["low_path"].to_pylist(), rows["low_text"].to_pylist(), docs)

    for batch in batches:
        shard = batch["shard"].to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(1, np.int64)
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if shard[x] != now and held:
                yield from made()
                held = []
            now = int(shard[x])
            held.append(batch.slice(x, y - x))
    if held:
        yield from made()


def build(chunks: DataFrame, path: str | None = None, shard: int = SHARD) -> Index:
    """The index of chunks (path, ordinal, start_line, end_line, text), written below `path` or in the shared folder.

    Null texts are empty. Keys are taken to be distinct. A shard has `shard` chunks at most, and that is 4096 at most.
    """
    if not 0 < shard <= 4096:
        raise ValueError("a shard has 1 to 4096 chunks")
    spark = chunks.sparkSession
    path = path or scratch(spark, "keyword-index")
    order = ["path", "start_line", "ordinal"]
    dealt = chunks.select(*order, "end_line", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    length, front = F.char_length("text"), F.char_length("path")
    d = (2 * F.greatest(front - 2, F.lit(0)) + F.greatest(length - 2, F.lit(0))).cast("long").alias("d")
    rows = dealt.select(*order, "end_line", F.lower("path").alias("low_path"), F.lower("text").alias("low_text"), (front + length).alias("size"), d, F.spark_partition_id().alias("pid"))
    known = [*order, "end_line", "d"]
    docs = T.StructType([T.StructField("number", T.LongType()), *[T.StructField(c, rows.schema[c].dataType) for c in known]])
    schema = T.StructType([*T.StructType.fromDDL(_BLOCKS).fields, T.StructField("docs", T.ArrayType(docs))])
    made = rows.mapInArrow(lambda batches: _blocks(_numbered(batches, shard), docs.names), schema)
    made.sortWithinPartitions("gram", "shard").write.parquet(f"{path}/blocks")
    spans = spark.read.parquet(f"{path}/blocks").groupBy(F.input_file_name().alias("file")).agg(F.min("gram").alias("first"), F.max("gram").alias("last"))
    whole = _docs(spark, path).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean")).first()
    facts = {"n": whole["n"], "mean": whole["mean"], "files": sorted([r["first"], r["last"], r["file"]] for r in spans.collect())}  # a row a file
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/facts")  # last: an index without it is not whole
    return opened(spark, path)


def _docs(spark: SparkSession, path: str) -> DataFrame:
    """number, path, start_line, ordinal, end_line, d of every chunk, from the blocks of lengths."""
    return spark.read.parquet(f"{path}/blocks").where(F.col("gram") == LENGTHS).select(F.inline("docs"))


def opened(spark: SparkSession, path: str) -> Index:
    """An index that build() wrote."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    return Index(_docs(spark, path), spark.read.schema(_BLOCKS).parquet(f"{path}/blocks"), facts["files"], facts["n"], facts["mean"], path)


def blocks_of(index: Index, grams: set[int]) -> DataFrame:
    """The blocks of some trigrams, from the files alone that have any of them."""
    wanted = sorted(grams)
    files = [f for first, last, f in index.files if bisect.bisect_right(wanted, last) > bisect.bisect_left(wanted, first)]
    spark = index.blocks.sparkSession
    if not files:
        return index.blocks.where("false")
    keys = spark.createDataFrame([(g,) for g in wanted], "gram long")  # those of a bounded set of queries
    rows = spark.read.schema(_BLOCKS).parquet(*files)
    if len(wanted) <= MOST_FILTERS:
        rows = rows.where(functools.reduce(lambda a, b: a | b, [F.col("gram") == g for g in wanted]))  # bounds of pages
    return rows.join(F.broadcast(keys), "gram", "left_semi")


# --- searching ---


class _Lists:
    """The blocks of one shard; a block is decoded when a term first needs it, its places only if chunks are left."""

    def __init__(self):
        self.raw: dict[int, list] = {}
        self.chunks: dict[int, np.ndarray] = {}
        self.places: dict[int, np.ndarray] = {}
        self.seen, self.read = 0, 0

    def add(self, gram: int, n: int, chunks: bytes, counts: bytes, places: bytes) -> None:
        self.raw.setdefault(gram, []).append((n, chunks, counts, places))
        self.seen += 1

    def size(self, gram: int) -> int:
        return sum(b[0] for b in self.raw.get(gram, ()))

    def chunks_of(self, gram: int) -> np.ndarray:
        if gram not in self.chunks:
            self.chunks[gram] = np.sort(np.concatenate([np.cumsum(decoded(b[1])) for b in self.raw[gram]]))
        return self.chunks[gram]

    def places_of(self, gram: int) -> np.ndarray:
        """chunk << 40 | place of each place of a trigram, ascending."""
        if gram not in self.places:
            out = []
            for _, chunks, counts, places in self.raw[gram]:
                k, gap = decoded(counts), decoded(places)
                total = np.cumsum(gap)
                head = np.append(0, np.cumsum(k))[:-1]
                out.append(np.repeat(np.cumsum(decoded(chunks)), k) << 40 | total - np.repeat(total[head] - gap[head], k))
                self.read += 1
            self.places[gram] = np.sort(np.concatenate(out)) if len(out) > 1 else out[0]
        return self.places[gram]


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, x)
    return (at < len(sorted_)) & (sorted_[np.minimum(at, len(sorted_) - 1)] == x)


def _matches(lists: _Lists, grams: list[int]) -> np.ndarray:
    """chunk << 40 | place of each place where trigrams stand one behind the other."""
    order = sorted(range(len(grams)), key=lambda i: lists.size(grams[i]))
    left = lists.chunks_of(grams[order[0]])
    for i in order[1:]:
        left = left[_among(left, lists.chunks_of(grams[i]))]
        if not len(left):
            return left
    found = lists.places_of(grams[order[0]])
    found = found[_among(found >> 40, left)] - order[0]
    for i in order[1:]:
        if not len(found):
            break
        found = found[_among(found + i, lists.places_of(grams[i]))]
    return found


def overlaps(term: str) -> bool:
    """Whether two places of a term can overlap: it ends as it begins."""
    return any(term.startswith(term[i:]) for i in range(1, len(term)))


def _apart(found: np.ndarray, size: int) -> np.ndarray:
    """Of ascending places of a term of some size, the first and each next one that begins behind the one taken before it."""
    taken = np.zeros(len(found), bool)
    behind = np.searchsorted(found, found + size)
    now = np.flatnonzero(np.append(True, np.diff(found) >= size))  # these overlap nothing before them: all runs go on side by side
    end = np.append(now[1:], len(found))
    while len(now):
        taken[now] = True
        now = behind[now]
        now, end = now[now < end], end[now < end]
    return found[taken]


def _hits_of(lists: _Lists, terms: list[tuple[int, list[int], bool]]) -> dict[str, np.ndarray]:
    """term, chunk, f and d of all matches in one shard: f counts matches in the path twice, d is the length.

    A term (number, trigrams, whether its places are taken apart).
    """
    front, length = np.zeros(4096, np.int64), np.zeros(4096, np.int64)
    for _, chunks, paths, texts in lists.raw.get(LENGTHS, ()):
        c, a, b = np.cumsum(decoded(chunks)), decoded(paths), decoded(texts)
        front[c] = a
        length[c] = 2 * np.maximum(a - 2, 0) + np.maximum(b - 2, 0)
    out = {"term": [], "chunk": [], "f": [], "d": []}
    for number, grams, apart in terms:
        found = _matches(lists, grams)
        if not len(found):
            continue
        if apart:
            found = _apart(found, len(grams) + GRAM - 1)
        chunk, place = found >> 40, found & ((1 << 40) - 1)
        f = np.bincount(chunk, np.where(place < front[chunk], 2, 1), 4096)
        some = np.flatnonzero(f)
        for name, x in (("term", np.full(len(some), number)), ("chunk", some), ("f", f[some]), ("d", length[some])):
            out[name].append(x.astype(np.int32))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int32) for k, v in out.items()}


_HITS = "shard long, seen int, read int, term array<int>, chunk array<int>, f array<int>, d array<int>"


def hits(index: Index, terms: list[str], apart: bool = False) -> DataFrame:
    """shard, seen and read (blocks at hand, and those whose places were decoded), and term (its number), chunk, f, d of each match.

    A row a shard; terms of three letters or more, in lower case. With `apart` places that overlap the one counted before do
    not count.
    """
    plan = [(i, gram_codes(t), apart and overlaps(t)) for i, t in enumerate(terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, _Lists()

        def out() -> pa.RecordBatch:
            h = _hits_of(lists, [p for p in plan if all(g in lists.raw for g in p[1])])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([lists.seen], pa.int32()), pa.array([lists.read], pa.int32()), *[pa.array([h[c]], pa.list_(pa.int32())) for c in ("term", "chunk", "f", "d")]], names=["shard", "seen", "read", "term", "chunk", "f", "d"])

        for batch in batches:
            for gram, shard, n, chunks, counts, places in zip(*(batch[c].to_pylist() for c in ("gram", "shard", "n", "chunks", "counts", "places"))):
                if shard != now and lists.raw:
                    yield out()
                    lists = _Lists()
                now = shard
                lists.add(gram, n, chunks, counts, places)
        if lists.raw:
            yield out()

    wanted = blocks_of(index, {LENGTHS} | {g for _, grams, _ in plan for g in grams})
    return wanted.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _HITS)


def _weight(f: np.ndarray, d: np.ndarray, mean: float) -> np.ndarray:
    return f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean)) if mean else f * 0.0


def search(index: Index, queries: DataFrame, k: int, apart: bool = False) -> DataFrame:
    """query_id, number, score of the k best chunks of each query (query_id, terms: lower-case, three letters or more).

    Scores are negative, less is better, and rounded to six places; equal ones go by number. Queries are a bounded set. All
    places of a term count, or with `apart` those alone that do not overlap the one counted before: "ana" is in "banana" once.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    asked = [(r["query_id"], r["terms"]) for r in queries.select("query_id", F.array_distinct("terms").alias("terms")).collect()]  # a bounded set
    terms = sorted({t for _, ts in asked for t in ts})
    schema = T.StructType([queries.schema["query_id"], T.StructField("number", T.LongType()), T.StructField("score", T.DoubleType())])
    if not terms or not index.n:
        return spark.createDataFrame([], schema)
    place, mean = {t: i for i, t in enumerate(terms)}, index.mean
    found = stored(hits(index, terms, apart), "hits")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each term of a shard: how many chunks, and the k largest weights."""
        for batch in batches:
            for i in range(len(batch)):
                term, chunk, f, d = (batch[c][i].values.to_numpy() for c in ("term", "chunk", "f", "d"))
                w = _weight(f, d, mean)
                edges = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)) if len(term) else np.zeros(1, np.int64)
                for a, b in zip(edges[:-1], edges[1:]):
                    best = a + np.argsort(-w[a:b])[:k]
                    n = len(best)
                    yield pa.RecordBatch.from_arrays([pa.array([term[a]] * n, pa.int32()), pa.array(np.append(b - a, np.zeros(n - 1)), pa.int64()), pa.array((batch["shard"][i].as_py() << 12) | chunk[best].astype(np.int64)), pa.array(w[best])], names=["term", "n", "number", "w"])

    first = stored(found.select("shard", "term", "chunk", "f", "d").mapInArrow(tops, "term int, n long, number long, w double"), "tops")
    held = {r["term"]: r["n"] for r in first.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
    idf = {t: raw if (raw := np.log((index.n - n + 0.5) / (n + 0.5))) > 0 else 1e-6 for t, n in held.items()}
    known = {q: [(place[t], idf[place[t]]) for t in ts if place[t] in idf] for q, ts in asked}
    # what the k-th best chunk of a query has at least: of any of its terms alone
    pairs = spark.createDataFrame([(i, t, float(x)) for i, (q, ts) in enumerate(known.items()) for t, x in ts], "q int, term int, idf double")  # a bounded set
    best_of_term = first.withColumn("at", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w")))).where(F.col("at") <= k)
    alone = best_of_term.join(F.broadcast(pairs), "term").groupBy("q", "number").agg(F.max(F.col("w") * F.col("idf")).alias("s"))
    kth = alone.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("at") == k)
    least = {r["q"]: r["s"] for r in kth.collect()}  # a row a query
    plan: dict[int, list] = {}
    for i, ts in enumerate(known.values()):
        for t, x in ts:
            plan.setdefault(t, []).append((i, x))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                term, chunk, f, d = (batch[c][i].values.to_numpy() for c in ("term", "chunk", "f", "d"))
                if not len(term):
                    continue
                w = _weight(f, d, mean)
                edges = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term))
                parts: dict[int, list] = {}
                for a, b in zip(edges[:-1], edges[1:]):
                    top = float(w[a:b].max())
                    for q, x in plan.get(int(term[a]), ()):
                        parts.setdefault(q, []).append((a, b, x, x * top))
                qs, numbers, scores = [], [], []
                for q, lists in parts.items():
                    if sum(p[3] for p in lists) < least.get(q, 0.0) - SLACK:
                        continue  # no chunk of this shard is among the best
                    total = np.zeros(4096)
                    for a, b, x, _ in lists:
                        total[chunk[a:b]] += x * w[a:b]
                    some = np.flatnonzero(total > max(0.0, least.get(q, 0.0) - SLACK))
                    if len(some) > k:
                        some = some[np.lexsort((some, -np.round(total[some], 6)))[:k]]
                    qs += [q] * len(some)
                    numbers.append(some)
                    scores.append(-total[some])
                if qs:
                    yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int32()), pa.array((batch["shard"][i].as_py() << 12) | np.concatenate(numbers)), pa.array(np.concatenate(scores))], names=["q", "number", "score"])

    rows = found.select("shard", "term", "chunk", "f", "d").mapInArrow(score, "q int, number long, score double").withColumn("score", F.round("score", 6))
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("score", "number"))).where(F.col("at") <= k)
    names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], T.StructType([T.StructField("q", T.IntegerType()), queries.schema["query_id"]]))
    out = stored(ranked.join(F.broadcast(names), "q").select("query_id", "number", "score"), "found")  # k rows a query
    discard(found, first)
    return out


def matching(index: Index, term_sets: dict[str, list[str]]) -> DataFrame:
    """set, number of all chunks that have any term of a set; terms in lower case, of three letters or more."""
    terms = sorted({t for ts in term_sets.values() for t in ts if len(t) >= GRAM})
    spark = index.docs.sparkSession
    if not terms:
        return spark.createDataFrame([], "set string, number long")
    names = spark.createDataFrame([(terms.index(t), s) for s, ts in term_sets.items() for t in set(ts) if len(t) >= GRAM], "term int, set string")
    rows = hits(index, terms).select("shard", F.explode(F.arrays_zip("term", "chunk")).alias("h")).select("h.term", F.shiftleft("shard", 12).bitwiseOR(F.col("h.chunk")).alias("number"))
    return rows.join(F.broadcast(names), "term").select("set", "number").distinct()
