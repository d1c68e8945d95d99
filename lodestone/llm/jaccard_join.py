"""Near-duplicates by an exact Jaccard join of word 5-gram sets, with prefix filters under three global token orders.

Two sets of similarity 0.75 or more share a token among the first n - ceil(0.75 n) + 1 tokens of each, under any total
order of tokens; more than that, if their first common token has i tokens before it in the one and j in the other, then
the smaller of n - i and m - j bounds their overlap. Three orders are used:

1. rare tokens first (frequencies are counted over all distinct sets; ties by hash). Its prefixes are the index: each
   token's list of documents, with the places i. Passages that very many documents share stand at the end of this
   order, and so the bound by places rules pairs out that have nothing else in common, before any row is made of them.
2. and 3. two orders by hash. Prefixes under both are stored with each document, and a pair must share a token in each
   of them, within the length that its two sizes ask for, besides agreeing with the sketches of its sets.

Only pairs that pass under all three orders have their texts moved and their sets compared.

What keeps hot groups cheap: equal sets are one class and one document stands for it. A token's list is worked off from
its front: the documents with the fewest rarer tokens, of which a group's original is the first, are pivots. They are
tried against all others of the list, and what links is one component from then on, within which no pair is tried. A
list whose documents are in one component is done. Rounds take 1 pivot a list, then 64, 1024 and so on until
every list is done, and no pair is tried twice, so the join is exact.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts of fewer than five
words have one shingle, their whole sequence; rows that repeat a doc_id are one document with several texts; rows
with a null doc_id link with nothing and have a null component; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NONSPACE, Words, discard, key_bitmap, mix, release, settle, stored, text_slices, with_hit
from .components import components

U = np.uint64
WORDS = 5
LEAST = 75  # percent of the union: 4 * overlap >= 3 * union, or 7 * overlap >= 3 * (n + m)
GROUP = 64  # documents that a hub's text is sent along with
TOGETHER = 256  # texts that are compared in one call
HOT_LEAST, HOT_MOST = 8, 1 << 20  # frequencies from which tokens are made known, and how many at most
BUCKET_TOKENS = 1 << 20  # tokens that one task counts
SPOTS = 27  # the bitmap of repeated tokens has 2**27 bits at any size of the input
PIVOTS = (1, 64, 16)  # of a list: in the first round, in the second, and times as many in each further one
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, flat; and where each text's begin."""
    w = Words(data, offsets, NONSPACE)
    h = w.hashes()
    a, b = w.splits[:-1], w.splits[1:]
    n = b - a
    rolled = np.zeros(max(0, len(h) - WORDS + 1), U)
    for i in range(WORDS):
        rolled += h[i : len(h) - WORDS + 1 + i] * ODD[i] if len(rolled) else U(0)
    rolled = mix(rolled)
    sets, size = [], np.zeros(len(n), np.int64)
    for i, (s, e) in enumerate(zip(a.tolist(), b.tolist())):
        if e - s >= WORDS:
            own = np.sort(rolled[s : e - WORDS + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif e > s:
            own = mix((h[s:e] * np.array(ODD[: e - s], U)).sum(keepdims=True) + U(e - s))
        else:
            continue
        sets.append(own)
        size[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.append(0, np.cumsum(size))


def prefix_size(n):
    return n - (n * LEAST + 99) // 100 + 1


def first_tokens(key: np.ndarray) -> np.ndarray:
    """Places of the tokens of a set's prefix under the order of `key`, in that order."""
    p = prefix_size(len(key))
    some = np.argpartition(key, p - 1)[:p]
    return some[np.argsort(key[some])]


# --- what is kept of each document -------------------------------------------------------------


def sketches(flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """How many tokens of each set fall into each of about n / 4 ranges of a hash, a byte each; empty if one does not fit.

    The sum of the smaller counts of two sets bounds their overlap from above.
    """
    n = np.diff(at)
    bits = np.maximum(4, np.ceil(np.log2(np.maximum(n, 1) / 4)).astype(np.int64))
    edge = np.append(0, np.cumsum(1 << bits))
    own = np.repeat(np.arange(len(n)), n)
    spot = ((flat * ODD[7]) >> (U(64) - bits[own].astype(U))).astype(np.int64)
    count = np.bincount(edge[own] + spot, minlength=int(edge[-1]))
    small = np.minimum(count, 255).astype(np.uint8)
    return [b"" if (count[a:b] > 255).any() else small[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]


def most_shared(x: bytes, y: bytes) -> int:
    """The largest overlap that two sketches allow; the finer one is folded to the width of the other."""
    p, q = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (x, y))
    while len(p) > len(q):
        p = p.reshape(-1, 2).sum(1)
    while len(q) > len(p):
        q = q.reshape(-1, 2).sum(1)
    return int(np.minimum(p, q).sum())


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), h1, h2 (of the whole set), sketch, and its prefixes under orders 2 and 3 (32 bits a token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                flat, at = shingle_sets(data, offsets)
                n = np.diff(at)
                full = np.flatnonzero(n)
                h = np.zeros((2, len(n)), U)
                prefixes: list[list[bytes]] = []
                for k, x in enumerate((flat * ODD[5], mix(flat ^ ODD[6]))):
                    h[k, full] = np.add.reduceat(x, at[full]) if len(full) else 0
                for k in (1, 3):
                    key, short = flat * ODD[k], (flat >> U(32)).astype(np.uint32)
                    prefixes.append([short[a:b][first_tokens(key[a:b])].tobytes() if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(sketches(flat, at), pa.binary()), *(pa.array(p, pa.binary()) for p in prefixes)], names=["doc_id", "n", "h1", "h2", "sketch", "second", "third"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch binary, second binary, third binary")


# --- order 1: how often a token stands in all sets -----------------------------------------------


class Rarity:
    """The first order: tokens seen once, then those seen again, then the known frequent ones by frequency; ties by hash.

    repeated: a bitmap by the tokens' top bits; known: the frequent tokens' top 32 + bits bits, ascending; grade: their
    frequencies as steps of a fourth root of two. Which tokens are known decides how fast the join is, never its result.
    """

    def __init__(self, bits: int, repeated: np.ndarray, known: np.ndarray, grade: np.ndarray):
        self.bits, self.repeated, self.known, self.grade = bits, repeated, known, grade

    def rank(self, flat: np.ndarray) -> np.ndarray:
        spot = flat >> U(64 - SPOTS)
        out = (self.repeated[spot >> U(3)] >> (spot & U(7)).astype(np.uint8)) & np.uint8(1)
        if len(self.known):
            key = flat >> U(32 - self.bits)
            at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            out = np.where(self.known[at] == key, self.grade[at], out)
        return out


def packed(docs: DataFrame, bits: int) -> DataFrame:
    """bucket (the top `bits` bits of tokens), tokens (their next 32 bits, u32 each, distinct), counts (u32 each)."""

    def rows(sets: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(sets) >> U(32 - bits), return_counts=True)
        bucket = (token >> U(32)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        end = np.append(cut[1:], len(bucket))
        small, many = token.astype(np.uint32), n.astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, end)], pa.binary()) for x in (small, many))], names=["bucket", "tokens", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            for _, data, offsets in text_slices(batch, "text"):
                flat, _ = shingle_sets(data, offsets)
                waiting += [flat] if len(flat) else []
                if sum(map(len, waiting)) >= BUCKET_TOKENS:
                    yield rows(waiting)
                    waiting = []
        if waiting:
            yield rows(waiting)

    return docs.mapInArrow(run, "bucket int, tokens binary, counts binary")


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()])


def rarity(texts: DataFrame, tokens: int) -> Rarity:
    """Count the tokens of all texts, by ranges of their hashes, and keep a bitmap of fixed size and HOT_MOST of them."""
    bits = max(6, min(24, int(tokens // BUCKET_TOKENS).bit_length()))
    least = HOT_LEAST

    def count(group: pa.Table) -> pa.Table:
        token, n = joined(group["tokens"], np.uint32), joined(group["counts"], np.uint32).astype(np.int64)
        by = np.argsort(token, kind="stable")
        token, n = token[by], n[by]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        token, total = token[first], np.add.reduceat(n, first)
        own = np.zeros(1 << (SPOTS - bits), np.uint8)
        own[token[total > 1] >> np.uint32(32 - (SPOTS - bits))] = 1
        bucket = group["bucket"][0].as_py()
        often = total >= least
        keys, many = token[often].astype(np.int64) | (bucket << 32), total[often]
        return pa.table({"bucket": pa.array([bucket, *[None] * len(keys)], pa.int32()), "spots": pa.array([np.packbits(own, bitorder="little").tobytes(), *[None] * len(keys)], pa.binary()), "token": pa.array([None, *keys.tolist()], pa.int64()), "grade": pa.array([None, *np.minimum(2 + np.floor(4 * np.log2(many)), 255).astype(np.int32).tolist()], pa.int32())})

    found = stored(packed(texts, bits).groupBy("bucket").applyInArrow(count, "bucket int, spots binary, token long, grade int"), "frequent")
    width = 1 << (SPOTS - bits - 3)
    repeated = np.zeros(1 << (SPOTS - 3), np.uint8)
    for r in found.where("bucket IS NOT NULL").select("bucket", "spots").toLocalIterator():  # 16 MB in all
        repeated[r["bucket"] * width : (r["bucket"] + 1) * width] = np.frombuffer(r["spots"], np.uint8)
    room, take = HOT_MOST, F.lit(False)
    for r in found.where("token IS NOT NULL").groupBy("grade").count().orderBy(F.desc("grade")).collect():  # 254 rows at most
        some = F.col("grade") == r["grade"]
        if r["count"] > room:  # of the last grade that finds room, as many as do
            some = some & (F.pmod(F.xxhash64("token"), F.lit(r["count"])) < int(0.9 * room))
        take, room = take | some, room - min(room, r["count"])
    got = found.where("token IS NOT NULL").where(take).select("token", "grade").toArrow()  # HOT_MOST rows at most
    discard(found)
    token, grade = got["token"].to_numpy(), got["grade"].to_numpy()
    by = np.argsort(token)
    known, grade = token[by].astype(U), grade[by].astype(np.uint8)
    del got, token, by
    release()
    return Rarity(bits, repeated, known, grade)


def index(texts: DataFrame, shared) -> DataFrame:
    """token, doc, n, i: the repeated tokens of each text's prefix under the first order, i tokens after its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                flat, at = shingle_sets(data, offsets)
                if not len(flat):
                    continue
                rank = order.rank(flat)
                key = (rank.astype(U) << U(56)) | ((flat * ODD[0]) >> U(8))
                token, place, own = [], [], []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    if b == a:
                        continue
                    first = first_tokens(key[a:b])
                    i = np.flatnonzero(rank[a:b][first])
                    token.append(flat[a:b][first[i]])
                    place.append(i)
                    own.append(np.full(len(i), k))
                k = np.concatenate(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), part["doc_id"].take(pa.array(k)), pa.array(np.diff(at)[k].astype(np.int32)), pa.array(np.concatenate(place).astype(np.int32))], names=["token", "doc", "n", "i"])

    return texts.mapInArrow(run, "token long, doc long, n int, i int")


# --- filters on pairs, and the comparison of sets ------------------------------------------------

#: The overlap that the places of a shared token allow is enough for the two sizes.
BY_PLACE = "7 * least(x.n - x.i, y.n - y.i) >= 3 * (x.n + y.n)"


def alike(n: int, m: int, x: tuple[bytes, bytes, bytes], y: tuple[bytes, bytes, bytes]) -> bool:
    """Whether sizes, sketches and the prefixes under orders 2 and 3 allow sets of n and m tokens to link."""
    need = -(-3 * (n + m) // 7)
    if min(n, m) < need or x[0] and y[0] and most_shared(x[0], y[0]) < need:
        return False
    return all(not set(memoryview(p).cast("I")[: n - need + 1]).isdisjoint(memoryview(q).cast("I")[: m - need + 1]) for p, q in zip(x[1:], y[1:]))


def allowed(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that the filters let through. No text moves for it."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "tried-ids")
    some = with_hit(feats, key_bitmap(ids, "doc_id", "tried-bits"), "doc_id").where("hit").select("doc_id", "n", "sketch", "second", "third")
    side = lambda at, k: some.select(F.col("doc_id").alias(at), *(F.col(c).alias(f"{c}_{k}") for c in some.columns[1:]))
    both = pairs.join(side("a", 0), "a").join(side("b", 1), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                n, s, p, q = ([part[f"{c}_{k}"].to_pylist() for k in (0, 1)] for c in ("n", "sketch", "second", "third"))
                keep = [alike(*each[:2], each[2:5], each[5:]) for each in zip(n[0], n[1], s[0], p[0], q[0], s[1], p[1], q[1])]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # a document with several texts has a row for each combination
    return stored(both.select("a", "b", *(f"{c}_{k}" for c in some.columns[1:] for k in (0, 1))).mapInArrow(run, "a long, b long").distinct(), "allowed")


def verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough. The text of a hub, a, moves once for GROUP others."""
    size = pairs.groupBy("a").agg((F.count(F.lit(1)) / GROUP).cast("int").alias("last"))
    others = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int").alias("slot"), F.col("b").alias("doc_id"), F.lit(False).alias("hub"))
    need = stored(others.unionByName(others.select("a", "slot", F.col("a").alias("doc_id"), F.lit(True).alias("hub")).distinct()), "wanted")
    groups = max(1, need.count() // TOGETHER)
    ids = stored(need.select("doc_id").distinct(), "wanted-ids")
    moved = with_hit(texts, key_bitmap(ids, "doc_id", "wanted-bits"), "doc_id").where("hit").select("doc_id", "text").join(need, "doc_id")

    def compare(group: pa.Table) -> pa.Table:
        hubs: dict[tuple, list[np.ndarray]] = {}
        rest: list[tuple[tuple, int, np.ndarray]] = []
        for batch in group.combine_chunks().to_batches():
            for part, data, offsets in text_slices(batch, "text"):
                flat, at = shingle_sets(data, offsets)
                for k, (a, slot, doc, hub) in enumerate(zip(*(part[c].to_pylist() for c in ("a", "slot", "doc_id", "hub")))):
                    own = flat[at[k] : at[k + 1]]
                    if hub:
                        hubs.setdefault((a, slot), []).append(own)
                    else:
                        rest.append(((a, slot), doc, own))
        links = set()
        for at, doc, x in rest:
            for y in hubs.get(at, ()):
                if len(x) and len(y):
                    found = np.searchsorted(y, x)
                    same = int((y[np.minimum(found, len(y) - 1)] == x).sum())
                    if 100 * same >= LEAST * (len(x) + len(y) - same):
                        links.add((at[0], doc))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    grouped = moved.withColumn("g", F.pmod(F.xxhash64("a", "slot"), F.lit(groups))).groupBy("g")
    return stored(grouped.applyInArrow(compare, "a long, b long"), "links")


# --- the join --------------------------------------------------------------------------------------


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component of all nodes with a link, after new links between documents."""
    if label is None:
        return stored(components(links), "labels")
    of = lambda at: label.select(F.col("node").alias(at), F.col("component").alias(f"{at}_now"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_now", "a").alias("a"), F.coalesce("b_now", "b").alias("b"))
    new = stored(components(edges), "labels-new")
    moved = label.join(new.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return stored(moved.unionByName(new.join(label, "node", "left_anti").select("node", "component")), "labels")


def joined_lists(texts: DataFrame, feats: DataFrame, entries: DataFrame, known: DataFrame) -> DataFrame:
    """node, component of every document that links, from the lists of the first order and links known already."""
    label, tried, rest, pivots = merged(None, known), None, entries, PIVOTS[0]
    while True:
        part = rest.join(label.withColumnRenamed("node", "doc"), "doc", "left").select("token", "n", "doc", F.struct("i", "doc").alias("at"), "i", F.coalesce("component", "doc").alias("component"))
        part = stored(part, "lists")
        if pivots == 1:
            front = part.groupBy("token").agg(F.min(F.struct("at", "n", "component")).alias("f"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "f.at", "f.n", "f.component")
        else:
            by = Window.partitionBy("token").orderBy("at")
            front = part.select("token", "at", "n", "component", F.row_number().over(by).alias("rank")).where(F.col("rank") <= pivots).drop("rank")
        front = stored(front.withColumn("i", F.col("at.i")), "pivots")
        pairs = part.alias("x").join(front.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.at") > F.col("y.at")) & (F.col("x.component") != F.col("y.component")) & F.expr(BY_PLACE))
        hub, doc = F.col("y.at.doc"), F.col("x.doc")
        pairs = pairs.where(hub != doc).groupBy(F.least(hub, doc).alias("p"), F.greatest(hub, doc).alias("q")).agg(F.min(hub).alias("a"))
        if tried is not None:
            pairs = pairs.join(tried, ["p", "q"], "left_anti")
        pairs = stored(pairs, "pairs")
        tried = pairs.select("p", "q") if tried is None else tried.unionByName(pairs.select("p", "q"))
        links = verify(texts, allowed(pairs.select("a", (F.col("p") + F.col("q") - F.col("a")).alias("b")), feats))
        label = merged(label, links)
        # what stands behind the pivots, unless it is in one component by now
        last = front.groupBy("token").agg(F.max("at").alias("last"))
        behind = part.join(last, "token").where("at > last").select("token", "doc", "n", "i")
        now = behind.join(label.withColumnRenamed("node", "doc"), "doc", "left").groupBy("token").agg(F.min(F.coalesce("component", "doc")).alias("low"), F.max(F.coalesce("component", "doc")).alias("high"))
        rest = stored(behind.join(now.where("low < high").select("token"), "token", "left_semi"), "rest")
        discard(part, front)
        settle(texts.sparkSession)
        if rest.isEmpty():
            return label
        pivots = PIVOTS[1] if pivots == PIVOTS[0] else pivots * PIVOTS[2]


def without_copies(docs: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, text of the documents that stand for a class, without moving the texts of copies."""
    copies = stored(named.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("own")).where("NOT own").select("doc_id"), "copies")
    bitmap = key_bitmap(copies, "doc_id", "copies-bits")
    reps = named.where("doc_id = rep").select("doc_id").distinct()
    wrong = stored(with_hit(reps, bitmap, "doc_id").where("hit").select("doc_id"), "taken-for-copies")
    once = with_hit(docs, bitmap, "doc_id", "copy")
    twice = with_hit(once, key_bitmap(wrong, "doc_id", "taken-bits"), "doc_id")
    unsure = twice.where("copy AND hit").select("doc_id", "text").join(wrong, "doc_id", "left_semi")
    return once.where("NOT copy").select("doc_id", "text").unionByName(unsure)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = stored(features(every), "features")
    some = feats.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(some.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    named = stored(some.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"]).select("doc_id", "n", "rep"), "named")
    # one document that is in several classes (a repeated doc_id) joins them
    several = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    ties = named.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    texts = without_copies(every.where("doc_id IS NOT NULL"), named)
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast(rarity(texts, tokens))  # 16 MB of bits, HOT_MOST tokens at most
    entries = stored(index(texts, shared), "index")
    shared.destroy()
    settle(spark)
    label = joined_lists(texts, feats, entries, ties)
    named = named.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    others = feats.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(others)
