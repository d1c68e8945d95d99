r"""Token ids as binary files: tokenised, range-coded in blocks, written in doc_id order, read back.

Documents are dealt by ranges of doc_id, sorted, tokenised and coded; frames go out through Spark's own
writer, so that files appear only when their task commits, on whatever store the folder is on.

File format. A file is a row of frames, each followed by one byte 0x0A. A frame, little-endian:
  magic b"LDTK" | kind u8 (1: documents, 2: block) | part u32 | number u32 | count u32 | alphabet u32 |
  size u32 | crc32 u32 | payload of `size` bytes
`part` counts the ranges of doc_id from 0, `number` the frames of a kind within a part. A documents
frame has `count` doc_ids as i64 (unset where null), their validity as u8 and their numbers of ids as
i64; crc32 is that of the payload. A block frame has the range coder's bytes of `count` ids below `alphabet`; crc32
is that of the ids as u32, and a block decodes alone. Documents follow each other through the blocks of a part without gaps.

Defined results: null and empty texts give only the end id; a null doc_id sorts first; equal doc_ids
are kept, ordered by text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rangecoder
from .common import LOWER, discard, scratch, stored, text_slices

FRAME = struct.Struct("<4sBIIIIII")
MAGIC = b"LDTK"
END = 1
RUN = 4096
TOGETHER = 1000  # runs that are merged in one call


#: The normalisation and the splitting for which the cuts are known to hold.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def cuts_hold(definition: dict) -> bool:
    """Whether a tokenizer file splits as SPLITTING does and merges within words alone, always alike."""
    model = definition["model"]
    return all(definition.get(k) == v for k, v in SPLITTING.items()) and model["type"] == "BPE" and not model.get("dropout")


class WordEncoder:
    """The tokenizers library on the distinct runs of a batch, behind a bounded memo.

    Where a file's normalisation and splitting are those of SPLITTING, no word goes on past white space (no branch of the
    pattern takes any), nor from a Latin-1 letter to an ASCII sign other than the apostrophe or back (each branch takes either
    letters, or a digit, or neither, but for those that begin with an apostrophe), and an ASCII digit is a word of its own;
    none of them composes with what stands before it; and letters are lower-cased one by one. So texts are lower-cased in
    ASCII and cut there, and runs are encoded alone. A run of plain letters, of signs, or a digit is one word to the library's
    merge model; others take its whole way. With any other file, and in slices that have a special token's text, the library
    encodes whole texts.
    """

    #: Letters that are lower-cased one by one and composed already; or signs, which stand for themselves; or a digit.
    PLAIN = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+|[0-9]")
    ALL_PLAIN = re.compile(f"(?:(?:{PLAIN.pattern}) )+")

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(definition)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        known = json.loads(definition)
        self.cut = cuts_hold(known)
        # the same merges without normalisation and splitting, for words that are spelled out already
        self.merges = Tokenizer.from_str(json.dumps({**known, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []})) if self.cut else None
        suffix, vocabulary = known["model"].get("end_of_word_suffix"), self.lib.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word, and nothing else does
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.spelling = {i: "".join(self.letters[b] for b in chr(i).encode()) for i in range(0xC0, 0x100)}
        tried = ["hello", "Äpfel", "année", "...", "x", "|$*", "7"]
        if self.merges and np.concatenate([self.whole(t) for t in tried]).tolist() != self.many(tried)[0].tolist():
            self.merges = None
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def many(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of up to TOGETHER runs, flat, and how many each has; plain ones are merged side by side, as words of one text."""
        text = " ".join(runs)
        if self.merges and self.ALL_PLAIN.fullmatch(text + " "):
            spelled = text if text.isascii() else text.lower().translate(self.spelling)
            ids = np.array(self.merges.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(runs) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        elif self.merges and len(runs) > 1:
            plain = np.array([self.PLAIN.fullmatch(r) is not None for r in runs])
            if plain.any():
                got = [np.zeros(0, np.int32)] * len(runs)
                ids, size = self.many([r for r, own in zip(runs, plain) if own])
                for i, x in zip(np.flatnonzero(plain).tolist(), np.split(ids, np.cumsum(size)[:-1])):
                    got[i] = x
                for i in np.flatnonzero(~plain).tolist():
                    got[i] = np.array(self.whole(runs[i]), np.int32)
                return np.concatenate(got), np.array([len(x) for x in got], np.int64)
        lists = [self.whole(r) for r in runs]
        size = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(size.sum())), size

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def places(self, runs: list[str], most: int = 200_000) -> np.ndarray:
        if len(self.memo) > most:
            self.forget()
        at = np.fromiter((self.memo.get(x, -1) for x in runs), np.int64, len(runs))
        new = np.flatnonzero(at < 0)
        ids, size = [self.ids], [self.size]
        for a in range(0, len(new), TOGETHER):
            got = self.many([runs[i] for i in new[a : a + TOGETHER].tolist()])
            ids.append(got[0])
            size.append(got[1])
        at[new] = len(self.memo) + np.arange(len(new))
        self.memo.update(zip((runs[i] for i in new.tolist()), at[new].tolist()))
        self.ids, self.size = np.concatenate(ids), np.concatenate(size)
        self.at = np.append(0, np.cumsum(self.size))[:-1]
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with the end id behind each text, and the number of each text's ids."""
        raw = data.tobytes()
        if not self.cut or any(t in raw or t.upper() in raw.upper() for t in self.special):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
            ids = [np.append(np.array(e.ids, np.int32), np.int32(END)) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
            return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.array([len(x) for x in ids], np.int64)
        kind = _KIND[data]  # 0: white space, 1: a letter, 2: a sign, 3: another byte, 4: a digit
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] & 0x3F) != 0x17]
        lead = lead[(data[lead + 1] & 0x3F) != 0x37]  # neither × nor ÷: letters of Latin-1
        kind[lead] = kind[lead + 1] = 1
        word = kind > 0
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        data = LOWER[data]
        begin[1:] |= _CUT[kind[:-1] * np.uint8(5) + kind[1:]]
        inside = offsets[:-1][offsets[:-1] < len(data)]
        begin[inside] = word[inside]
        start = np.flatnonzero(begin)
        gap = np.flatnonzero(~word)
        stop = np.append(start[1:], len(data))
        if len(gap):
            near = np.searchsorted(gap, start)
            stop = np.minimum(stop, np.append(gap, len(data))[near])
        # only the runs' bytes, so that they stand side by side
        size = stop - start
        edge = np.append(0, np.cumsum(size))
        runs = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[word])))
        code = runs.dictionary_encode()
        which = self.places(code.dictionary.to_pylist())[np.asarray(code.indices)]
        k = self.size[which]
        first = np.append(0, np.cumsum(k))
        per_text = np.diff(first[np.searchsorted(start, offsets)]) + 1
        last = np.cumsum(per_text)
        out = np.full(int(last[-1]) if len(last) else 0, END, np.int32)
        mine = np.ones(len(out), bool)
        mine[last - 1] = False
        out[mine] = self.ids[np.repeat(self.at[which] - first[:-1], k) + np.arange(first[-1])]
        return out, per_text


_b = np.arange(256)
_KIND = np.full(256, 3, np.uint8)
_KIND[(_b == 32) | ((_b >= 9) & (_b <= 13))] = 0
_KIND[((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122))] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2
_KIND[48:58] = 4
_CUT = np.zeros(25, bool)  # by the kinds of two neighbours, whether a run begins between them
_CUT[[1 * 5 + 2, 2 * 5 + 1, *(k * 5 + 4 for k in range(5)), *(4 * 5 + k for k in (1, 2, 4))]] = True


class Definition:
    """A tokenizer file as it travels to the executors."""

    def __init__(self, text: str):
        self.text = text

    @property
    def encoder(self) -> WordEncoder:
        return _encoder(self.text)


@lru_cache(maxsize=2)
def _encoder(text: str) -> WordEncoder:
    return WordEncoder(text)


def frame(kind: int, part: int, number: int, count: int, alphabet: int, crc: int, payload: bytes) -> bytes:
    return FRAME.pack(MAGIC, kind, part, number, count, alphabet, len(payload), crc) + payload


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, part_bytes: int = 16 << 20, check_one_in: int = 200) -> None:
    """Write token files below `path`. `part_bytes` of text make a range of doc_ids, and so a file.

    One text in `check_one_in` of each batch is also encoded whole by the library; a difference fails the job.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(Definition(f.read()))  # a vocabulary, of fixed size
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // part_bytes))
    sorted_docs = src.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value.encoder
        part, n_docs, n_blocks, waiting = 0, 0, 0, np.zeros(0, np.int32)

        def blocks(last: bool) -> Iterator[bytes]:
            nonlocal waiting, n_blocks
            while len(waiting) >= rangecoder.BLOCK or last and len(waiting):
                ids, waiting = waiting[: rangecoder.BLOCK], waiting[rangecoder.BLOCK :]
                alphabet = int(ids.max()) + 1
                yield frame(2, part, n_blocks, len(ids), alphabet, zlib.crc32(ids.astype("<u4").tobytes()), rangecoder.encode(ids, alphabet))
                n_blocks += 1

        def out(frames) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", 2 << 20):
                part = rows["part"][0].as_py()
                ids, size = enc.encode(data, offsets)
                first = np.append(0, np.cumsum(size))
                for i in range(0, len(rows), check_one_in):
                    if enc.lib.encode(rows["text"][i].as_py(), add_special_tokens=False).ids != ids[first[i] : first[i + 1] - 1].tolist():
                        raise ValueError(f"differs from the library: {rows['text'][i].as_py()[:200]!r}")
                valid = np.asarray(rows["doc_id"].is_valid())
                payload = np.asarray(rows["doc_id"].fill_null(0)).astype("<i8").tobytes() + valid.astype(np.uint8).tobytes() + size.astype("<i8").tobytes()
                waiting = np.append(waiting, ids)
                yield out([frame(1, part, n_docs, len(rows), 0, zlib.crc32(payload), payload), *blocks(False)])
                n_docs += 1
        if len(waiting):
            yield out(list(blocks(True)))

    sorted_docs.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def frames(content: bytes) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    at = 0
    while at < len(content):
        magic, kind, part, number, count, alphabet, size, crc = FRAME.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        at += FRAME.size
        yield kind, part, number, count, alphabet, crc, content[at : at + size]
        at += size + 1


def read_part(content: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """The part's number, its doc_ids, their numbers of ids, and all ids; checks every checksum."""
    docs: dict[int, tuple[list, np.ndarray]] = {}
    blocks: dict[int, np.ndarray] = {}
    part = 0
    for kind, part, number, count, alphabet, crc, payload in frames(content):
        if kind == 1:
            if zlib.crc32(payload) != crc:
                raise ValueError(f"part {part}: documents frame {number} is damaged")
            ids = np.frombuffer(payload, "<i8", count)
            valid = np.frombuffer(payload, np.uint8, count, 8 * count)
            docs[number] = ([int(i) if v else None for i, v in zip(ids, valid)], np.frombuffer(payload, "<i8", count, 9 * count))
        else:
            blocks[number] = rangecoder.decode(payload, count, alphabet).astype(np.int32)
            if zlib.crc32(blocks[number].astype("<u4").tobytes()) != crc:
                raise ValueError(f"part {part}: block {number} is damaged")
    flat = [blocks[n] for n in sorted(blocks)]
    names = [d for n in sorted(docs) for d in docs[n][0]]
    sizes = np.concatenate([docs[n][1] for n in sorted(docs)]) if docs else np.zeros(0, np.int64)
    return part, names, sizes, np.concatenate(flat) if flat else np.zeros(0, np.int32)


def read_tokens(spark, path: str) -> DataFrame:
    """part, doc_id, start (ids before it in the part), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                content = batch["content"][i].as_py()
                if not content:
                    continue
                part, names, sizes, ids = read_part(content)
                edge = np.append(0, np.cumsum(sizes))
                for a in range(0, len(names), 2000):
                    b = min(a + 2000, len(names))
                    yield pa.RecordBatch.from_arrays([pa.array([part] * (b - a), pa.int32()), pa.array(names[a:b], pa.int64()), pa.array(edge[a:b], pa.int64()), pa.ListArray.from_arrays(pa.array((edge[a : b + 1] - edge[a]).astype(np.int32)), pa.array(ids[edge[a] : edge[b]]))], names=["part", "doc_id", "start", "ids"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def digests(tokens: DataFrame) -> DataFrame:
    """part, doc_id, start, n_tokens, ids_crc32 of what read_tokens gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            flat, edge = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([b["part"], b["doc_id"], b["start"], pc.list_value_length(ids).cast(pa.int64()), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from files written and read back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_file, path)
    got = stored(digests(read_tokens(docs.sparkSession, path)), "token-digests")
    # a row a file: added up within runs of RUN files, and over the runs
    totals = got.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("run", (F.col("part") / RUN).cast("int"))
    runs = totals.groupBy("run").agg(F.sum("n").alias("n"))
    earlier = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("earlier"))
    before = totals.join(F.broadcast(earlier), "run").select("part", (F.sum("n").over(Window.partitionBy("run").orderBy("part")) - F.col("n") + F.col("earlier")).alias("before"))
    discard(path)
    return got.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
