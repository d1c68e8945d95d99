r"""Token counts by transducers that are compiled from a byte-level BPE tokenizer file; no ids are made.

Two deterministic machines count. The first splits: its states say in what kind of run a character stands, and its
transitions say where a word begins, here or one character back. It has eleven states, so a chunk of text is a map from the
state before it to the state behind it: the maps of all chunks of a slice are worked out side by side, composed by a
parallel prefix scan, and each chunk is then run once from the state that the scan gives it. The second machine merges: it
reads a word byte by byte, and a transition is annotated with the tokens that the byte adds to the count of what was read
so far (or takes from it, where a byte completes a longer token). The last token of a word's front is the one token that
ends there and may follow the last token of what stands before it, and two tokens may follow each other unless some merge
across their border comes before those that made them; so a state needs no more than the open tokens' places in the trie
of the vocabulary, with the last token and the count at each of their beginnings. States and transitions are made when a
text first needs them and kept in tables of bounded size, which start anew when they are full.

A share of every batch is also counted by the library, and the job fails if they differ. Only files that split by the
pattern of byte-level BPE, and whose merges come in the order of their parts, are read; others raise ValueError.

Defined results: null and empty texts have no bytes and no tokens; the text of an added token counts as one token and parts
the text around it; rows repeat as they come; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

LIMIT = 1024
CHUNK = 64  # characters of a chunk, whose state map is one row
MOST_STATES = 250_000
MOST_WORDS = 150_000
BLOCK = 8 << 20  # bytes of one text that are worked on at once
NEVER = 1 << 40

# --- the splitting machine ---

#: Classes of characters: letters that may end a contraction are told apart from others.
OTHER_LETTER, ONE, FIRST, E, L, NUMBER, BLANK, SPACE, QUOTE, SIGN, BREAK = range(11)
#: States: at a beginning; in letters, digits, signs; after one blank or other space, after several that end in either; after
#: a quote that begins a word, and after it and r, v or l.
START, LETTERS, DIGITS, SIGNS, BLANK1, SPACE1, BLANKS, SPACES, QUOTED, QUOTED_R, QUOTED_L = range(11)
STATES = 11
HERE, BACK = 1, 2  # a word begins with this character, or with the one before


def _split_step(state: int, kind: int) -> tuple[int, int]:
    letter = kind in (OTHER_LETTER, ONE, FIRST, E, L)
    run = LETTERS if letter else {NUMBER: DIGITS, BLANK: BLANK1, SPACE: SPACE1, QUOTE: QUOTED, SIGN: SIGNS, BREAK: START}[kind]
    joined = SIGNS if kind == QUOTE else run  # what a blank in front takes along
    white = kind in (BLANK, SPACE)
    if kind == BREAK:
        return START, BACK if state in (QUOTED_R, QUOTED_L) else 0
    if state == LETTERS and letter or state == DIGITS and kind == NUMBER:
        return state, 0
    if state == SIGNS and kind in (QUOTE, SIGN):
        return SIGNS, 0
    if state in (BLANK1, SPACE1, BLANKS, SPACES):
        if white:
            return (BLANKS if kind == BLANK else SPACES), 0
        if state in (BLANK1, BLANKS):
            return joined, BACK if state == BLANKS else 0
        return run, HERE | (BACK if state == SPACES else 0)
    if state == QUOTED:
        if kind == ONE:
            return START, 0
        if kind in (FIRST, L):
            return (QUOTED_R if kind == FIRST else QUOTED_L), 0
        if kind in (QUOTE, SIGN):
            return SIGNS, 0
    if state in (QUOTED_R, QUOTED_L):
        if kind == (E if state == QUOTED_R else L):
            return START, 0
        return (LETTERS, BACK) if letter else (run, HERE | BACK)
    return run, HERE


_STEPS = [[_split_step(s, k) for s in range(STATES)] for k in range(11)]
NEXT = np.array([[n for n, _ in row] for row in _STEPS], np.uint8).ravel()
MARK = np.array([[m for _, m in row] for row in _STEPS], np.uint8).ravel()


@lru_cache(maxsize=1)
def classes() -> bytes:
    """The class of every code point, with letters, digits and space as the library's own patterns have them."""
    from tokenizers import Regex, pre_tokenizers

    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    kind = np.full(0x110000, SIGN, np.uint8)
    for pattern, value in ((r"\p{L}+", OTHER_LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        split = pre_tokenizers.Split(Regex(pattern), "removed")
        for some in np.array_split(points, 512):
            inside = np.ones(len(some), bool)
            for _, (a, b) in split.pre_tokenize_str(some.astype("<u4").tobytes().decode("utf-32-le")):
                inside[a:b] = False
            kind[some[inside]] = value
    kind[ord(" ")], kind[ord("'")] = BLANK, QUOTE
    for letters, value in (("stmd", ONE), ("rv", FIRST), ("e", E), ("l", L)):
        kind[[ord(c) for c in letters]] = value
    return kind.tobytes()


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps, row by row: `then` after `first`."""
    return np.take_along_axis(then, first.astype(np.intp), 1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i: the maps 0 to i composed. Pairs are composed side by side, then pairs of pairs, and so on."""
    if len(maps) < 2:
        return maps
    half = len(maps) // 2
    pairs = prefix_scan(compose(maps[0 : 2 * half : 2], maps[1 : 2 * half : 2]))
    out = np.empty_like(maps)
    out[0], out[1 : 2 * half : 2] = maps[0], pairs
    rest = maps[2::2]
    out[2::2] = compose(pairs[: len(rest)], rest)
    return out


def split_marks(kinds: np.ndarray) -> np.ndarray:
    """Whether a word begins with each character, of characters given by class; START before the first."""
    n = len(kinds)
    rows = n // CHUNK + 1  # one more place at least, for what the end decides
    cells = np.full(rows * CHUNK, BREAK, np.int16)
    cells[:n] = kinds
    cells = (cells * STATES).reshape(rows, CHUNK)
    now = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for j in range(CHUNK):
        now = NEXT[cells[:, j, None] + now]
    at = np.zeros(rows, np.uint8)
    at[1:] = prefix_scan(now)[:-1, START]
    marks = np.empty((rows, CHUNK), np.uint8)
    for j in range(CHUNK):
        k = cells[:, j] + at
        marks[:, j], at = MARK[k], NEXT[k]
    flat = marks.ravel()
    begins = flat[:n] & HERE > 0
    return begins | (flat[1 : n + 1] & BACK > 0)


# --- the merging machine ---


class Merges:
    """A byte-level BPE vocabulary as a transducer over bytes that counts tokens."""

    def __init__(self, definition: str, kinds: bytes):
        self.kinds = np.frombuffer(kinds, np.uint8)
        d = json.loads(definition)
        model = d["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        split = d.get("pre_tokenizer") or {}
        if not plain or d.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level BPE files without normalisation, which split by their usual pattern, are read")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in d["added_tokens"]):
            raise ValueError("added tokens that take what stands around them are not read")
        self.added = [t["content"].encode() for t in d["added_tokens"]]
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
        ids = {name: i for name, i in model["vocab"].items() if all(c in byte for c in name)}
        size = max(model["vocab"].values()) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, t = ids[a], ids[b], ids[a + b]
            if self.rank[t] >= 0 or self.rank[x] >= r or self.rank[y] >= r or (len(a) > 1 and self.rank[x] < 0) or (len(b) > 1 and self.rank[y] < 0):
                raise ValueError("only vocabularies with one merge a token, behind those of its parts, are read")
            self.left[t], self.right[t], self.rank[t] = x, y, r
            self.pair[x << 24 | y] = t
        made = [True] * size
        for t in sorted(ids.values(), key=lambda t: self.rank[t]):
            if self.rank[t] >= 0:
                x, y = self.left[t], self.right[t]
                made[t] = made[x] and made[y] and not self.crossed(x, y, self.rank[t])
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for name, t in ids.items():
            if not made[t] or self.rank[t] < 0 and len(name) > 1:
                continue
            node = 0
            for c in name:
                self.inner[node] = True
                nxt = self.child.get(node << 8 | byte[c])
                if nxt is None:
                    nxt = self.child[node << 8 | byte[c]] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token[node] = t
        if any(self.token[self.child.get(b, 0)] < 0 for b in range(256)):
            raise ValueError("only vocabularies with a token for each byte are read")
        self.forget_states()
        self.words: dict[bytes, int] = {}

    def crossed(self, one: int, two: int, before: int = NEVER) -> bool:
        """Whether a merge across the border of two tokens comes before the merges that made them, and before `before`."""
        a, a_gone = one, NEVER
        while a >= 0:
            b, b_gone = two, NEVER
            while b >= 0:
                m = self.pair.get(a << 24 | b)
                if m is not None and self.rank[m] < a_gone and self.rank[m] <= b_gone and self.rank[m] < before:
                    return True
                b_gone, b = self.rank[b], self.left[b]
            a_gone, a = self.rank[a], self.right[a]
        return False

    def forget_states(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.step: dict[int, int] = {}  # state and byte: the next state, and the tokens that come or go
        self.follows: dict[int, bool] = {}

    def _transition(self, state: int, byte: int) -> int:
        child, token, inner, follows = self.child, self.token, self.inner, self.follows
        opened, comes, last = [], 0, -1
        for node, before, count in self.states[state]:  # the longest first
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            t = token[node]
            if t >= 0 and last < 0:
                if before < 0:
                    comes, last = count + 1, t
                else:
                    fits = follows.get(before << 24 | t)
                    if fits is None:
                        fits = follows[before << 24 | t] = not self.crossed(before, t)
                    if fits:
                        comes, last = count + 1, t
            if inner[node]:
                opened.append((node, before, count))
        new = (*[(node, before, count - comes) for node, before, count in opened], (0, last, 0)) if comes else (*opened, (0, last, 0))
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        self.step[state << 8 | byte] = got = to << 16 | comes + 32768
        return got

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.forget_states()
        state, n, step = 0, 0, self.step
        for i, byte in enumerate(word):
            got = step.get(state << 8 | byte)
            if got is None:
                if i and not i % 4096 and len(self.states) > 4 * MOST_STATES:  # one endless word
                    here = self.states[state]
                    self.forget_states()
                    step, state = self.step, 1
                    self.states.append(here)
                    self.number[here] = 1
                got = self._transition(state, byte)
            state, n = got >> 16, n + (got & 65535) - 32768
        return n

    # --- texts ---

    def _words(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin of each segment, whether it is a word, and the segments' tokens, of bytes that are parted before `breaks`."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[lead]
        points = first.astype(np.int32)
        for low, high, size, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
            at = np.flatnonzero((first >= low) & (first < high))
            if len(at):
                p = points[at] & mask
                for k in range(1, size):
                    p = p << 6 | (data[np.minimum(lead[at] + k, len(data) - 1)] & 0x3F)
                points[at] = p
        kinds = self.kinds[points]
        added = self._added(data)
        for a, b in added:
            kinds[np.searchsorted(lead, a) : np.searchsorted(lead, b)] = BREAK
        place = np.searchsorted(lead, breaks)
        marks = split_marks(np.insert(kinds, place, BREAK))
        marks = np.delete(marks, place + np.arange(len(place)))
        kind = np.zeros(len(data) + 1, np.uint8)  # of each byte: 1 where a word begins, 2 where something else does
        kind[breaks] = 2
        for a, b in added:
            kind[a], kind[b] = 3, kind[b] or 2
        kind[lead[marks]] = 1
        begin = np.flatnonzero(kind[:-1])
        segment = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
        code = segment.dictionary_encode()
        tokens = np.array([self._known(w) for w in code.dictionary.to_pylist()], np.int64)[np.asarray(code.indices)] if len(begin) else np.zeros(0, np.int64)
        tokens[kind[begin] == 2] = 0
        tokens[kind[begin] == 3] = 1
        return begin, kind[begin] == 1, tokens

    def _known(self, word: bytes) -> int:
        n = self.words.get(word)
        if n is None:
            if len(self.words) > MOST_WORDS:
                self.words = {}
            n = self.count(word)
            if len(word) <= 64:
                self.words[word] = n
        return n

    def _added(self, data: np.ndarray) -> list[tuple[int, int]]:
        """The places of added tokens, the leftmost first, of those at one place the longest."""
        raw, found = data.tobytes(), []
        for name in self.added:
            at = raw.find(name)
            while at >= 0:
                found.append((at, -len(name)))
                at = raw.find(name, at + 1)
        out, end = [], 0
        for at, size in sorted(found):
            if at >= end:
                end = at - size
                out.append((at, end))
        return out

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text of a buffer."""
        if len(data) > BLOCK and len(offsets) == 2:
            return np.array([self._count_long(data)])
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        begin, _, tokens = self._words(data, offsets[:-1])
        total = np.append(0, np.cumsum(tokens))
        return np.diff(total[np.searchsorted(begin, offsets)])

    def _count_long(self, data: np.ndarray) -> int:
        """One long text, block by block; a block's last words are read again with the next one."""
        n, at, size = 0, 0, BLOCK
        while at < len(data):
            end = min(at + size, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            begin, word, tokens = self._words(data[at:end], np.zeros(1, np.int64))
            if end == len(data):
                return n + int(tokens.sum())
            sure = begin[word & (begin < end - at - 1024)]
            if not len(sure) or not sure[-1]:  # a word longer than the block
                size *= 2
                continue
            n += int(tokens[begin < sure[-1]].sum())
            at, size = at + int(sure[-1]), BLOCK
        return n


class Definition:
    """A tokenizer file as it travels to the executors; each Python worker compiles it once."""

    def __init__(self, text: str):
        self.text, self.kinds = text, classes()

    @property
    def merges(self) -> Merges:
        return _merges(self.text, self.kinds)

    @property
    def library(self):
        return _library(self.text)


@lru_cache(maxsize=2)
def _merges(text: str, kinds: bytes) -> Merges:
    return Merges(text, kinds)


@lru_cache(maxsize=2)
def _library(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(text)
    lib.no_truncation()
    lib.no_padding()
    return lib


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, check_one_in: int = 200, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default) with n_bytes, n_tokens and over_limit of every whole text. A narrow pass.

    One text in `check_one_in` of each slice is also counted by the library; a difference fails the job.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(Definition(definition))  # a vocabulary, of fixed size
    src = docs.select(F.struct(*(keep or ["doc_id"])).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, library = shared.value.merges, shared.value.library
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", 2 << 20):
                n = merges.counts(data, offsets)
                for i in range(0, len(rows), check_one_in):
                    if len(library.encode(rows["text"][i].as_py(), add_special_tokens=False)) != n[i]:
                        raise ValueError(f"differs from the library: {rows['text'][i].as_py()[:200]!r}")
                yield pa.RecordBatch.from_arrays([rows["row"], pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["row", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return src.mapInArrow(run, schema).select("row.*", "n_bytes", "n_tokens", "over_limit")
