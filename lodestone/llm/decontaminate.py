"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of `window` words of the normalised benchmark texts are the automaton's patterns (an item of
fewer words, but not none, is one window). Each document is normalised byte for byte, so that word
numbers lead back to places in the original, and scanned once; whatever windows end at a place mark
their words as hit. One narrow pass over the documents, no shuffle, whatever the benchmark's size.

The automaton is one of word numbers (the benchmark's words by their 64-bit hash; any other word is 0) in flat arrays: sorted
edges, failure links, and links to the windows that end in a state. It is written to the shared folder once; Spark brings
the file to each executor, whose workers map it and share its pages. A state depends on the last `window` words alone, so
a batch is cut into lanes that start so many words early and go through the automaton side by side.

The automaton is made on the driver, level by level: some 16 bytes a node, of at most 13 nodes a word of the benchmark, so
up to 40 bytes a byte of its text. Documents never come there.

Defined results: null and empty texts have no words and no hits; items without words or with a null
item_id are left out; repeated items count once; an empty benchmark leaves everything clean; columns of
`docs` other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, release, scratch, text_slices

LANE = 256  # words that a lane takes


class Machine:
    """The automaton as flat arrays; state 0 is the root, state n has the edge keys[n - 1] from its parent.

    vocabulary: sorted hashes, word number = place + 1; keys: parent * size + word number, sorted; first: the root's
    edges by word number; fail: the longest proper suffix that is a state; end: number (from 1) of the longest window that
    is a suffix of the state, 0 for none. By window: length, after (the next shorter window that is its suffix), spots (its
    items are owners[spots[n - 1] : spots[n]]). names, cuts: the item ids in UTF-8, sorted.
    """

    ARRAYS = ("vocabulary", "keys", "first", "fail", "end", "length", "after", "spots", "owners", "names", "cuts")

    def __init__(self, window: int, arrays: dict[str, np.ndarray]):
        self.window = window
        self.__dict__.update(arrays)
        self.size = len(self.vocabulary) + 1

    @classmethod
    def build(cls, items: pa.Table, window: int) -> Machine:
        """items: item_id and text, both strings."""
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in items.select(["text"]).to_batches():
            for _, data, offsets in text_slices(batch, "text"):
                w = Words(data, offsets)
                hashes.append(w.hashes())
                counts.append(np.diff(w.splits))
        count = np.concatenate(counts)
        vocabulary, stream = np.unique(np.concatenate(hashes), return_inverse=True)
        stream, size = (stream + 1).astype(np.int64), len(vocabulary) + 1
        ids = [x.encode() for x in items["item_id"].to_pylist()]
        named = sorted(set(ids))
        number = {x: i for i, x in enumerate(named)}
        many = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
        item = np.repeat(np.array([number[x] for x in ids], np.int64), many)
        start = np.repeat(np.cumsum(count) - count - (np.cumsum(many) - many), many) + np.arange(many.sum())
        long = np.repeat(np.minimum(count, window), many)

        state, levels, fail = np.zeros(len(start), np.int64), [], [np.zeros(1, np.int32)]
        made, marks = 1, []  # states so far; (state, item) of each window
        live = np.arange(len(start))
        for depth in range(window):
            live = live[long[live] > depth]
            if not len(live):
                break
            keys, back = np.unique(state[live] * size + stream[start[live] + depth], return_inverse=True)
            state[live] = made + back
            parent, word = np.divmod(keys, size)
            own = np.zeros(len(keys), np.int32)
            if depth:
                links, edges, base = np.concatenate(fail), np.concatenate(levels), own
                todo = np.arange(len(keys))
                at = links[parent].astype(np.int64)
                while len(todo):
                    key = at * size + word[todo]
                    place = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
                    hit = edges[place] == key
                    base[todo[hit]] = place[hit] + 1
                    go = ~hit & (at > 0)
                    todo, at = todo[go], links[at[go]].astype(np.int64)
            levels.append(keys)
            fail.append(own)
            over = live[long[live] == depth + 1]
            marks.append(np.stack([state[over], item[over]], 1))
            made += len(keys)
        keys, links = np.concatenate([np.zeros(0, np.int64), *levels]), np.concatenate(fail)
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *marks])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        if len(pairs):
            pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))]
        ends, places = np.unique(pairs[:, 0], return_index=True)
        end = np.zeros(made, np.int32)
        end[ends] = np.arange(1, len(ends) + 1)
        after, length, a = np.zeros(len(ends), np.int32), np.zeros(len(ends), np.int32), 1
        for depth, level in enumerate(levels):  # links lead to lower levels, which are done
            b = a + len(level)
            shorter = end[links[a:b]]
            closes = end[a:b] > 0
            after[end[a:b][closes] - 1] = shorter[closes]
            length[end[a:b][closes] - 1] = depth + 1
            end[a:b] = np.where(closes, end[a:b], shorter)
            a = b
        first, roots = np.zeros(size, np.int32), len(levels[0]) if levels else 0
        first[keys[:roots]] = np.arange(1, roots + 1)
        return cls(window, {
            "vocabulary": vocabulary, "keys": keys, "first": first, "fail": links, "end": end, "length": length, "after": after,
            "spots": np.append(places, len(pairs)).astype(np.int64), "owners": pairs[:, 1].astype(np.int32),
            "names": np.frombuffer(b"".join(named), np.uint8), "cuts": np.cumsum([0, *map(len, named)]).astype(np.int64),
        })

    def write(self, path: str) -> None:
        """One file: the length of a header, the header, and the arrays at multiples of 64 bytes."""
        places, at = [], 0
        for name in self.ARRAYS:
            array = getattr(self, name)
            places.append([name, array.dtype.str, len(array), at])
            at += -(-array.nbytes // 64) * 64
        head = json.dumps({"window": self.window, "arrays": places}).encode()
        head += b" " * (-(len(head) + 8) % 64)
        system, file = pyarrow.fs.FileSystem.from_uri(path)
        system.create_dir(file.rsplit("/", 1)[0])
        with system.open_output_stream(file) as out:
            out.write(len(head).to_bytes(8, "little") + head)
            for name in self.ARRAYS:
                array = np.ascontiguousarray(getattr(self, name))
                out.write(memoryview(array).cast("B") if len(array) else b"")
                out.write(b"\0" * (-array.nbytes % 64))

    @classmethod
    def mapped(cls, file: str) -> Machine:
        with open(file, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        data = np.memmap(file, np.uint8, "r")
        return cls(head["window"], {name: np.frombuffer(data, np.dtype(kind), many, 8 + n + at) for name, kind, many, at in head["arrays"]})

    def numbers(self, words: Words) -> np.ndarray:
        if self.size == 1:
            return np.zeros(len(words.starts), np.int64)
        h = words.hashes()
        place = np.minimum(np.searchsorted(self.vocabulary, h), self.size - 2)
        return np.where(self.vocabulary[place] == h, place + 1, 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each."""
        out = np.zeros(len(state), np.int64)
        todo = np.flatnonzero(word)
        at, word = state[todo], word[todo]
        while len(todo):
            deep = at > 0
            out[todo[~deep]] = self.first[word[~deep]]
            todo, at, word = todo[deep], at[deep], word[deep]
            key = at * self.size + word
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            out[todo[hit]] = place[hit] + 1
            miss = ~hit
            todo, at, word = todo[miss], self.fail[at[miss]].astype(np.int64), word[miss]
        return out

    def states(self, numbers: np.ndarray) -> np.ndarray:
        """The state after each of the word numbers."""
        lead, lanes = self.window - 1, -(-len(numbers) // LANE)
        padded = np.zeros(lead + lanes * LANE, np.int64)
        padded[lead : lead + len(numbers)] = numbers
        out, state, base = np.zeros(lanes * LANE, np.int64), np.zeros(lanes, np.int64), np.arange(lanes) * LANE
        for t in range(lead + LANE):
            state = self.step(state, padded[base + t])
            if t >= lead:
                out[base + t - lead] = state
        return out[: len(numbers)]

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(number of the last word, number of the window) of every window in any of the texts."""
        none = np.zeros(0, np.int64)
        if not len(words.starts) or not len(self.keys):
            return none, none
        text = np.repeat(np.arange(len(words.splits) - 1), np.diff(words.splits))
        place = np.arange(len(words.starts)) + text  # a word that no window has lies between texts
        numbers = np.zeros(place[-1] + 1, np.int64)
        numbers[place] = self.numbers(words)
        found = self.end[self.states(numbers)[place]]
        at = np.flatnonzero(found)
        found = found[at]
        all_at, all_found = [none], [none]
        while len(at):
            all_at.append(at)
            all_found.append(found.astype(np.int64))
            found = self.after[found - 1]
            at, found = at[found > 0], found[found > 0]
        return np.concatenate(all_at), np.concatenate(all_found)

    def items(self, windows: np.ndarray) -> list[str]:
        """Ids of the items that have any of the windows, sorted."""
        own = np.zeros(len(self.cuts) - 1, bool)
        for n in np.unique(windows).tolist():
            own[self.owners[self.spots[n - 1] : self.spots[n]]] = True
        return [self.names[self.cuts[i] : self.cuts[i + 1]].tobytes().decode() for i in np.flatnonzero(own).tolist()]


_open: dict[str, Machine] = {}


def machine_of(name: str) -> Machine:
    """The automaton of a file that Spark has brought to this executor; a worker keeps the last one mapped."""
    if name not in _open:
        _open.clear()
        _open[name] = Machine.mapped(SparkFiles.get(name))
    return _open[name]


def shipped(spark: SparkSession, machine: Machine) -> str:
    """Writes the automaton to the shared folder, from where each executor fetches it once; the file's name."""
    path = f"{scratch(spark, 'automaton')}.bin"
    machine.write(path)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ITEMS = T.ArrayType(T.StringType())


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, item_cols: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted), spans (start and end of each run of hit
    words, in code points of the original text)."""
    text = F.concat_ws("\n", *[F.col(c).cast("string") for c in item_cols])
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), text.alias("text")).distinct()
    name = shipped(docs.sparkSession, Machine.build(items.toArrow(), window))
    release()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(name)
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                w = Words(data, offsets)
                at, windows = machine.hits(w)
                edge = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(edge, at - machine.length[windows - 1] + 1, 1)
                np.add.at(edge, at + 1, -1)
                hit = np.cumsum(edge[:-1]) > 0
                so_far = np.append(0, np.cumsum(hit))
                n_hit = so_far[w.splits[1:]] - so_far[w.splits[:-1]]
                order = np.argsort(at, kind="stable")
                at, windows = at[order], windows[order]
                found, spans = [[] for _ in range(len(part))], [[] for _ in range(len(part))]
                for i in np.flatnonzero(n_hit).tolist():
                    a, b = w.splits[i], w.splits[i + 1]
                    found[i] = machine.items(windows[np.searchsorted(at, a) : np.searchsorted(at, b)])
                    turn = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
                    points = np.append(0, np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80))
                    starts, ends = w.starts[a:b] - offsets[i], w.ends[a:b] - offsets[i]
                    spans[i] = [{"start": int(points[starts[x]]), "end": int(points[ends[y - 1]])} for x, y in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(w.splits), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, span)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", ITEMS), T.StructField("spans", RUNS)])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, scanned with the row carried along (no join)."""
    got = scan(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), benchmark)
    return got.where(f"NOT ({CONTAMINATED})").select("doc_id.*")
