"""SentencePiece encoding and decoding for merge-type vocabularies, in Arrow batches.

Encoding merges adjacent symbols in the order of their pieces' scores: an agenda holds every adjacent
pair whose concatenation is a piece, the best score (leftmost on ties) is merged, its two neighbours'
entries are renewed, until none is left. Texts are cut into runs of spaces with the word after them,
which no piece of the vocabulary spans, so that a batch only works on its distinct runs: their agendas
are the rows of a matrix, and each round pops the head of every row at once. Runs that are too long for
the matrix, and vocabularies or texts for which the cut is not safe, take a heap-based agenda over the
whole text. A fixed share of every batch is encoded by the library too, and the job fails if they differ.

Defined results: null and empty texts give only the begin and end ids; unknown characters fall back to
bytes, or to the unknown id without byte pieces; rows repeat as they come; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

SPACE = "▁"
NONE = np.int32(-1)
#: A model without normalisation gives it back unchanged.
ODD_TEXT = " aB  ﬁ Ａ é e\u0301 \u00a0x "


class Vocabulary:
    """A merge-type model as tables: characters, merges of adjacent symbols, bytes of each piece."""

    def __init__(self, model: bytes):
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        # what the tables don't know: a normaliser, no space in front, removed spaces, pieces out of use or of the user
        if any(sp.is_unused(i) for i in range(n)) or sp.decode(sp.encode(ODD_TEXT)) != ODD_TEXT or not sp.encode("a", out_type=str)[0].startswith(SPACE):
            raise ValueError("only models without normalisation and user-defined pieces, which put a space in front, are read")
        self.byte = np.full(256, self.unk, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
        self.has_bytes = bool((self.byte != self.unk).any())
        self.forget()
        # Symbols: pieces keep their ids; characters that are no piece come after them.
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.score = {i: sp.get_score(i) for i in self.ids.values()}
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.n = n
        self.cut_safe = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        parts = [(self.symbol(p[:k]), self.symbol(p[k:]), i) for p, i in self.ids.items() for k in range(1, len(p)) if (k == 1 or p[:k] in self.ids) and (len(p) - k == 1 or p[k:] in self.ids)]
        self.pairs = {(a, b): i for a, b, i in parts}
        key = np.array([a << 32 | b for a, b, _ in parts], np.uint64) if parts else np.zeros(0, np.uint64)
        # The score's rank orders merges; equal scores share a rank.
        self.rank = np.zeros(n, np.int32)
        order = sorted(self.score, key=lambda i: -self.score[i])
        for r, i in enumerate(order):
            self.rank[i] = self.rank[order[r - 1]] if r and self.score[order[r - 1]] == self.score[i] else r
        self._open(key, np.array([i for *_, i in parts], np.int32))
        self.piece = [(b"" if special[i] and not sp.is_byte(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode()) for i in range(n)]
        self.odd = np.array([sp.is_unknown(i) for i in range(n)])
        self.piece_data = np.frombuffer(b"".join(self.piece), np.uint8)
        self.piece_len = np.array([len(x) for x in self.piece], np.int64)
        self.piece_at = np.append(0, np.cumsum(self.piece_len))[:-1]

    def symbol(self, s: str) -> int:
        return self.ids[s] if s in self.ids else self.n + ord(s)

    def _open(self, key: np.ndarray, value: np.ndarray) -> None:
        """An open-addressing table of the pairs for lookups of whole arrays."""
        bits = max(4, int(len(key) * 4).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.slot_key, self.slot_value = np.full(size + 64, ~np.uint64(0)), np.full(size + 64, -1, np.int32)
        self.longest = 1
        for k, v in zip(key.tolist(), value.tolist()):
            at = (k * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits)
            probe = 1
            while self.slot_value[at] >= 0 and int(self.slot_key[at]) != k:
                at, probe = at + 1, probe + 1
            self.slot_key[at], self.slot_value[at] = k, v
            self.longest = max(self.longest, probe)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = (a.astype(np.int64).astype(np.uint64) << np.uint64(32)) | b.astype(np.int64).astype(np.uint64)
        at = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = np.full(key.shape, -1, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        for p in range(self.longest):
            at_t = at[todo] + p
            hit = self.slot_key[at_t] == key[todo]
            out[todo[hit]] = self.slot_value[at_t[hit]]
            todo = todo[~hit & (self.slot_value[at_t] >= 0)]
            if not len(todo):
                break
        return out

    # --- agendas ---

    def heap_agenda(self, text: str) -> list[int]:
        """Symbols of one text after all merges, by a heap of (rank, place)."""
        sym = [int(self.char[ord(c)]) if self.char[ord(c)] >= 0 else self.n + ord(c) for c in text]
        n, size = len(sym), [1] * len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (m := self.pairs.get((sym[i], sym[j]))) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, m, size[i] + size[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, m, total = heapq.heappop(heap)
            j = right[i]
            if size[i] == 0 or j < 0 or size[i] + size[j] != total or self.pairs.get((sym[i], sym[j])) != m:
                continue
            sym[i], size[i], size[j] = m, total, 0
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s, k in zip(sym, size) if k]

    def matrix_agenda(self, sym: np.ndarray) -> np.ndarray:
        """Rows of symbols, padded with -1, after all merges; each round merges the best pair of each row."""
        rows, width = sym.shape
        top = np.int32(2**31 - 1)
        pair = np.full((rows, width), -1, np.int32)
        pair[:, :-1] = self.merged(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(rows, width - 1)
        rank = np.where(pair >= 0, self.rank[pair], top)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.arange(rows)
        col = np.arange(width)
        while len(live):
            best = rank.argmin(1)
            r = np.arange(len(live))
            go = rank[r, best] < top
            if not go.all():
                done.append((live[~go], sym[~go]))
                live, sym, pair, rank, best = live[go], sym[go], pair[go], rank[go], best[go]
                if not len(live):
                    break
                r = np.arange(len(live))
            new = pair[r, best]
            # close the gap: what stands right of the merged pair moves one place to the left
            take = np.minimum(col[None] + (col[None] > best[:, None]), width - 1)
            sym = np.take_along_axis(sym, take, 1)
            sym[:, -1] = -1
            sym[r, best] = new
            take = np.minimum(col[None] + (col[None] >= best[:, None]), width - 1)
            pair, rank = np.take_along_axis(pair, take, 1), np.take_along_axis(rank, take, 1)
            pair[:, -1], rank[:, -1] = -1, top
            at = np.concatenate((best, np.maximum(best - 1, 0)))
            rr = np.concatenate((r, r))
            a, b = sym[rr, at], np.where(at + 1 < width, sym[rr, np.minimum(at + 1, width - 1)], -1)
            m = self.merged(a, b)
            pair[rr, at], rank[rr, at] = m, np.where(m >= 0, self.rank[m], top)
        out = np.full((rows, width), -1, np.int32)
        for i, s in done:
            out[i] = s
        return out

    # --- runs ---

    def runs(self, texts: pa.Array, widest: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, flat, and each text's length; texts as Arrow strings, which have no SPACE character."""
        n = len(texts)
        marked = pc.binary_join_element_wise("", texts, " ").cast(pa.large_string()) if n else texts.cast(pa.large_string())
        offsets = np.frombuffer(marked.buffers()[1], np.int64)[: n + 1]
        data = np.frombuffer(marked.buffers()[2], np.uint8)[: offsets[-1]]
        is_space = data == 32
        start = is_space.copy()
        start[1:] &= ~is_space[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(start)
        seg = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, offsets[-1]).astype(np.int64)), marked.buffers()[2])
        code = seg.dictionary_encode()
        which = self.known(code.dictionary, widest)[np.asarray(code.indices)]
        flat, first, size = self.memo_ids, self.memo_at, self.memo_size
        k = size[which]
        out = flat[np.repeat(first[which] - np.append(0, np.cumsum(k))[:-1], k) + np.arange(k.sum())]
        per_run = np.append(0, np.cumsum(k))
        return out, np.diff(per_run[np.searchsorted(at, offsets)])

    def known(self, runs: pa.Array, widest: int, most: int = 150_000) -> np.ndarray:
        """Places of distinct runs in the memo, which forgets everything beyond `most` runs."""
        if len(self.memo) > most:
            self.forget()
        names = runs.to_pylist()
        at = np.fromiter((self.memo.get(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            flat, size = self.encode_runs(runs.take(pa.array(new)), widest)
            at[new] = len(self.memo) + np.arange(len(new))
            self.memo.update(zip((names[i] for i in new.tolist()), at[new].tolist()))
            self.memo_at = np.append(self.memo_at, len(self.memo_ids) + np.append(0, np.cumsum(size))[:-1])
            self.memo_size = np.append(self.memo_size, size)
            self.memo_ids = np.append(self.memo_ids, flat)
        return at

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.memo_ids, self.memo_at, self.memo_size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_runs(self, runs: pa.Array, widest: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct runs, and their lengths."""
        n = len(runs)
        length = np.asarray(pc.utf8_length(runs)).astype(np.int64)
        points = np.frombuffer("".join(runs.to_pylist()).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        begin = np.append(0, np.cumsum(length))[:-1]
        sym = self.char[points]
        sym = np.where(sym >= 0, sym, self.n + points.astype(np.int32))
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # runs, flat symbols, lengths
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, widest):
            sel = np.flatnonzero((length > low) & (length <= high))
            low = high
            if not len(sel):
                continue
            idx = begin[sel][:, None] + np.arange(high)[None]
            block = np.where(np.arange(high)[None] < length[sel][:, None], sym[np.minimum(idx, len(sym) - 1)], NONE)
            got = self.matrix_agenda(block)
            keep = got >= 0
            pieces.append((sel, got[keep], keep.sum(1)))
        for i in np.flatnonzero(length > widest):
            got = np.array(self.heap_agenda(runs[int(i)].as_py().replace(" ", SPACE)), np.int32)
            pieces.append((np.array([i]), got, np.array([len(got)])))
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        flat, own = np.concatenate([p[1] for p in pieces]), np.repeat(np.concatenate([p[0] for p in pieces]), np.concatenate([p[2] for p in pieces]))
        flat, own = self.fall_back(flat, own)
        order = np.argsort(own, kind="stable")
        return flat[order], np.bincount(own, minlength=n)

    def fall_back(self, flat: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become byte pieces, or the unknown id."""
        odd = flat >= self.n
        if not odd.any():
            return flat, own
        if not self.has_bytes:
            return np.where(odd, self.unk, flat), own
        chars, back = np.unique(flat[odd], return_inverse=True)
        as_bytes = [self.byte[np.frombuffer(chr(c - self.n).encode(), np.uint8)] for c in chars.tolist()]
        size = np.ones(len(flat), np.int64)
        size[odd] = np.array([len(x) for x in as_bytes])[back]
        out = np.repeat(flat, size)
        out[np.repeat(odd, size)] = np.concatenate([as_bytes[i] for i in back.tolist()])
        return out, np.repeat(own, size)

    def encode_whole(self, text: str) -> np.ndarray:
        """One text, without any cut."""
        if not text:
            return np.zeros(0, np.int32)
        got = np.array(self.heap_agenda((SPACE + text).replace(" ", SPACE)), np.int32)
        return self.fall_back(got, np.zeros(len(got), np.int64))[0]

    # --- texts ---

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with begin and end ids, and offsets."""
        n = len(texts)
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0)) if n else np.zeros(0, bool)
        if self.cut_safe:
            odd = np.asarray(pc.match_substring(texts, SPACE)) if n else np.zeros(0, bool)
        else:
            odd = ~empty
        plain = np.flatnonzero(~odd & ~empty)
        flat, size = self.runs(texts.take(pa.array(plain))) if len(plain) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        length = np.zeros(n, np.int64)
        length[plain] = size
        slow = {int(i): self.encode_whole(texts[int(i)].as_py()) for i in np.flatnonzero(odd & ~empty)}
        for i, x in slow.items():
            length[i] = len(x)
        offsets = np.append(0, np.cumsum(length + 2))
        out = np.empty(offsets[-1], np.int32)
        out[offsets[:-1]], out[offsets[1:] - 1] = self.bos, self.eos
        at = offsets[:-1][plain] + 1
        out[np.repeat(at - np.append(0, np.cumsum(size))[:-1], size) + np.arange(len(flat))] = flat
        for i, x in slow.items():
            out[offsets[i] + 1 : offsets[i + 1] - 1] = x
        return out, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of ids as the library's decode gives them, in UTF-8."""
        size = self.piece_len[ids]
        ends = np.append(0, np.cumsum(size))
        data = self.piece_data[np.repeat(self.piece_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[offsets].tolist()
        odd = np.add.reduceat(np.append(self.odd[ids], False).astype(np.int64), np.minimum(offsets[:-1], len(ids))) > 0 if len(offsets) > 1 else []
        out = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            x = data[a + 1 : b] if data[a : a + 1] == b" " else data[a:b]  # the space that encoding puts in front
            try:
                x.decode()
                bad = odd[i]
            except UnicodeDecodeError:
                bad = True
            if bad:
                x = self.lib.decode(ids[offsets[i] : offsets[i + 1]].tolist()).encode()
            out.append(x)
        return out


class Model:
    """The model file as it travels to the executors; each Python worker builds its tables once."""

    def __init__(self, data: bytes):
        self.data = data

    @property
    def tables(self) -> Vocabulary:
        return _tables(self.data)


@lru_cache(maxsize=2)
def _tables(data: bytes) -> Vocabulary:
    return Vocabulary(data)


def _encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary, check_one_in: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[bytes]]]:
    """Rows, their ids (flat, with offsets) and decoded texts, of slices of the batches."""
    for batch in batches:
        for part, _, _ in text_slices(batch, "text", 2 << 20):
            texts = part["text"]
            ids, offsets = v.encode(texts)
            decoded = v.decode(ids, offsets)
            for i in range(0, len(texts), check_one_in):
                text, own = texts[i].as_py(), ids[offsets[i] : offsets[i + 1]].tolist()
                if v.lib.encode(text, add_bos=True, add_eos=True) != own or v.lib.decode(own).encode() != decoded[i]:
                    raise ValueError(f"differs from the library: {text[:200]!r}")
            yield part["row"], ids, offsets, decoded


def _source(docs: DataFrame, keep: list[str] | None) -> DataFrame:
    return docs.select(F.struct(*(keep or ["doc_id"])).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _shared(docs: DataFrame, model_file: str):
    with open(model_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(Model(f.read()))  # a vocabulary, of fixed size


def encode_decode(docs: DataFrame, model_file: str, check_one_in: int = 50, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default) with ids (begin and end ids included) and decoded, of every whole text.

    One text in `check_one_in` of each batch is also encoded and decoded by the library; a difference fails the job.
    """
    shared, src = _shared(docs, model_file), _source(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, offsets, decoded in _encoded(batches, shared.value.tables, check_one_in):
            yield pa.RecordBatch.from_arrays([row, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.binary()).view(pa.string())], names=["row", "ids", "decoded"])

    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return src.mapInArrow(run, schema).select("row.*", "ids", "decoded")


def digests(docs: DataFrame, model_file: str, check_one_in: int = 50) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_decode gives, in the same pass over the texts."""
    shared, src = _shared(docs, model_file), _source(docs, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, offsets, decoded in _encoded(batches, shared.value.tables, check_one_in):
            flat = ids.astype("<u4")
            sha = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
            text = [hashlib.sha256(x).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays([row, pa.array(np.diff(offsets), pa.int64()), pa.array(sha), pa.array(text)], names=["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return src.mapInArrow(run, schema).select("row.*", "n_tokens", "ids_sha256", "decoded_sha256")
