"""The trie of conversations' prefixes, with count-min screening of prefix digests.

A conversation is a row of turns; a node is a distinct front of such a row. Each front has a digest: a sum of its turns'
hashes, each times a power of its place, so that the digests of pieces of a conversation compose. A count-min sketch counts
the digests of all fronts. It never counts too few, so an estimate of one proves that a front has one conversation; such
fronts are nodes at once, where they stand. Only fronts that may be shared are shuffled and grouped exactly. Nodes are named
by their smallest conversation.

What a node sums over its subtree is summed over its conversations instead, so that no level waits for the one below. With
K(c) the length of those fronts of c that another conversation names, the lengths below a node, each (conversations - 1)
times, are the sum over its conversations of what K(c) exceeds the lengths before the node by; its leaves are the
conversations that name a leaf.

Nothing is gathered by conversation or node. Turns are dealt by ranges of (conversation, order), so a long conversation spans
tasks; running sums go on across borders by one row a partition on the driver. Look-ups by a key that has many rows broadcast
that key's one row: keys with more than a `HEAVY`th of all rows, so no more than HEAVY of them. The digest of conversations
that end at a node is a sequential function; ids are first sorted by ranges and joined into pieces of thousands, then hashed
as a stream.

Defined results: null role and text are empty; null turns come first; equal turns go by role, then the first 64 characters of
the text, then its hash, and repeated rows count as turns; rows without conv_id are left out; other columns are not read; an
empty table has no root and gives no rows. `%` is that of SQL. Two hashes of 62 bits stand for a front.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

FAMILY, MOST_HEAD = 100, 6  # conversations that share a head, and what the number of its turns is taken by
PRIME = (1 << 31) - 1
#: Any numbers below PRIME.
BASES = (1_000_003, 1_618_033_989, 577_215_665, 1_414_213_562)
LANES = [f"h{i}" for i in range(4)]
HEAVY = 20_000
LEAST_CELLS, MOST_CELLS, ROWS = 1 << 16, 1 << 24, 3
PIECE = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo PRIME."""
    out = np.ones(max(n, 1), np.int64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * pow(base, size, PRIME) % PRIME
        size += more
    return out


# --- running sums over ranges ---

_NAMES = ["conv_id", "pid", "at", "end", "n_chars", "upto", *LANES, *[f"q{i}" for i in range(4)], *[f"x{i}" for i in range(4)]]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()] + [pa.int32()] * 12
_RUN = "conv_id long, pid int, at long, end boolean, n_chars long, upto long, " + ", ".join(f"{c} int" for c in _NAMES[6:])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by conversation: each row's place, whether it is its conversation's last, and sums up to it."""
    conv, place, upto, q, held = None, 0, 0, [0] * 4, None

    def out(cols: dict, more: bool) -> pa.RecordBatch:
        ids = cols["conv_id"]
        end = np.append(ids[1:] != ids[:-1], more)
        return pa.RecordBatch.from_arrays([pa.array(end if n == "end" else cols[n], k) for n, k in zip(_NAMES, _KINDS)], names=_NAMES)

    for batch in batches:
        if not len(batch):
            continue
        ids = np.asarray(batch["conv_id"])
        new = np.append(conv is None or ids[0] != conv, ids[1:] != ids[:-1])
        if held is not None:
            yield out(held, bool(new[0]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))  # -1: begun in an earlier batch
        own = int((first < 0).sum())
        at = np.arange(len(ids)) + 1 - np.where(first < 0, -place, first)

        def since(x: np.ndarray, before: int) -> np.ndarray:
            total = np.append(0, np.cumsum(x))
            return total[1:] - total[np.maximum(first, 0)] + np.where(first < 0, before, 0)

        chars = np.asarray(batch["n_chars"])
        cols = {"conv_id": ids, "pid": np.asarray(batch["pid"]), "at": at, "n_chars": chars, "upto": since(chars, upto)}
        for i, base in enumerate(BASES):
            p = powers(base, int(at[own:].max(initial=0)) + 1)
            e = np.concatenate((powers(base, own)[:own] * pow(base, place + 1, PRIME) % PRIME, p[at[own:]]))
            cols[f"h{i}"] = np.asarray(batch[f"h{i}"], np.int64)
            share = cols[f"h{i}"] * e % PRIME
            cols[f"q{i}"] = since(share, q[i]) % PRIME
            cols[f"x{i}"] = (cols[f"q{i}"] - share) % PRIME
        held = cols
        conv, place, upto, q = ids[-1], int(at[-1]), int(cols["upto"][-1]), [int(cols[f"q{i}"][-1]) for i in range(4)]
    if held is not None:
        yield out(held, True)


def running(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """conv_id, at (from 1), end (the conversation's last row), n_chars, upto (n_chars so far), h0.. (as they came), q0..
    (digest up to the row) and x0.. (digest before it) of rows (conv_id, n_chars, h0..), each conversation's in `order`.

    The second table is the stored one behind it.
    """
    dealt = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    local = stored(dealt.select("conv_id", F.spark_partition_id().alias("pid"), "n_chars", *LANES).mapInArrow(_running, _RUN), name)
    tail = F.max_by(F.struct("at", "upto", "q0", "q1", "q2", "q3"), F.struct("conv_id", "at"))
    borders = sorted(local.groupBy("pid").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), tail.alias("tail")).collect(), key=lambda b: b["pid"])  # a row a partition
    conv, n, upto, q, facts = None, 0, 0, [0] * 4, []
    for b, follows in zip(borders, [*borders[1:], None]):
        if conv != b["first"]:
            n, upto, q = 0, 0, [0] * 4
        shift = [pow(x, n, PRIME) for x in BASES]
        facts.append((b["pid"], b["first"], b["last"], follows is not None and follows["first"] == b["last"], n, upto, *q, *shift))
        own = b["tail"]
        if b["first"] != b["last"]:
            n, upto, q, shift = 0, 0, [0] * 4, [1] * 4
        n, upto, q = n + own["at"], upto + own["upto"], [(s + w * own[f"q{i}"]) % PRIME for i, (s, w) in enumerate(zip(q, shift))]
        conv = b["last"]
    schema = "pid int, first long, last long, goes_on boolean, n long, above long, " + ", ".join(f"{c}{i} long" for c in "sw" for i in range(4))
    joined = local.join(F.broadcast(rows.sparkSession.createDataFrame(facts, schema)), "pid")  # a row a partition
    off = F.col("conv_id") == F.col("first")
    moved = lambda c, i: F.when(off, (F.col(f"s{i}") + F.col(f"w{i}") * F.col(f"{c}{i}")) % PRIME).otherwise(F.col(f"{c}{i}").cast("long")).alias(f"{c}{i}")
    end = F.col("end") & ~((F.col("conv_id") == F.col("last")) & F.col("goes_on"))
    place, length = F.col("at") + F.when(off, F.col("n")).otherwise(0), F.col("upto") + F.when(off, F.col("above")).otherwise(0)
    return joined.select("conv_id", place.alias("at"), end.alias("end"), "n_chars", length.alias("upto"), *LANES, *[moved(c, i) for c in "qx" for i in range(4)]), local


# --- conversations and their fronts ---


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % MOST_HEAD


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, the keys of its order, n_chars and the hash h0..h3 of each turn, without its text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = lambda salt: F.xxhash64(F.lit(f"turn {salt}"), role, text)
    lanes = [F.shiftrightunsigned(bits(i // 2), 31 * (i % 2)).bitwiseAND(PRIME).cast("int").alias(f"h{i}") for i in range(4)]
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, 64).alias("role"), F.substring(text, 1, 64).alias("front"), F.char_length(text).cast("long").alias("n_chars"), *lanes)


def fronts(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, end, n_chars, before of every front of a rebuilt conversation, stored; depth 0 has none.

    node and parent are digests, the root's is all zeros; `before` is the length of the turns above, `end` whether the
    conversation ends there.
    """
    own, behind = running(turns(conversations), ["turn", "role", "front", *LANES], "turns")
    kept = ["at", "n_chars", *LANES]
    heads = own.where(f"conv_id % {FAMILY} = 0 AND at < {MOST_HEAD}").select(F.col("conv_id").alias("head"), *kept)
    ids = own.where("at = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"))
    shared = ids.join(heads, "head").where(F.col("at") <= head_length(F.col("conv_id"))).select("conv_id", F.lit(0).alias("part"), *kept)
    rest = own.where(F.col("at") > head_length(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), *kept)
    whole, sums = running(shared.unionByName(rest), ["part", "at"], "rebuilt")
    pack = lambda c: F.struct(*[(F.shiftleft(F.col(f"{c}{i}"), 31) + F.col(f"{c}{i + 1}")).alias(n) for i, n in ((0, "a"), (2, "b"))])
    found = whole.select("conv_id", F.col("at").alias("depth"), pack("q").alias("node"), pack("x").alias("parent"), "end", "n_chars", (F.col("upto") - F.col("n_chars")).alias("before"))
    zero = F.lit(0).cast("long")
    turnless = ids.select("conv_id").join(whole.where("at = 1").select("conv_id", F.lit(False).alias("end")), "conv_id", "left")
    roots = turnless.select("conv_id", zero.alias("depth"), F.struct(zero.alias("a"), zero.alias("b")).alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.coalesce("end", F.lit(True)).alias("end"), zero.alias("n_chars"), zero.alias("before"))
    out = stored(found.unionByName(roots), "fronts")
    discard(behind, sums)
    return out


# --- the sketch ---


def cell(node: str, row: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"row {row}"), F.col(f"{node}.a"), F.col(f"{node}.b")), F.lit(cells)) + F.lit(row * cells)


def sketch(rows: DataFrame) -> tuple[DataFrame, int]:
    """A count-min sketch of the digests of fronts, as the bits of its counters that are above one; and its cells a row.

    Counters are sums of a partial aggregate. What screening asks of a counter is whether it is one, so one bit of each is
    kept: MOST_CELLS bits a row at most.
    """
    n = rows.where("depth > 0").count()
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (8 * n).bit_length()))
    counted = rows.where("depth > 0").select(F.explode(F.array(*[cell("node", r, cells) for r in range(ROWS)])).alias("cell")).groupBy("cell").count()
    words = counted.where("count > 1").groupBy(F.shiftright("cell", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(cell & 63 AS INT)))").alias("bits"))
    return stored(words, "sketch"), cells


def screened(rows: DataFrame, words: DataFrame, cells: int) -> DataFrame:
    """Adds `open`, `parent_open`: whether a front, and the one above it, may have several conversations. The root always may."""
    for node, name in (("node", "open"), ("parent", "parent_open")):
        above_one = F.lit(True)
        for r in range(ROWS):
            w, c = F.broadcast(words.select(F.col("word").alias(f"_w{r}"), F.col("bits").alias(f"_b{r}"))), cell(node, r, cells)  # ROWS * MOST_CELLS / 64 rows at most
            rows = rows.join(w, F.shiftright(c, 6).cast("int") == F.col(f"_w{r}"), "left")
            above_one = above_one & (F.coalesce(F.getbit(F.col(f"_b{r}"), c.bitwiseAND(63).cast("int")), F.lit(0)) == 1)
        rows = rows.withColumn(name, F.when(F.col("depth") <= (0 if node == "node" else 1), True).otherwise(above_one)).drop(*[f"_{x}{r}" for x in "wb" for r in range(ROWS)])
    return rows


# --- exact nodes ---


def looked_up(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the columns of facts, a row a key, or nulls. `weight` is how many rows have the key, `total` all of them.

    Keys of more than one in HEAVY rows, so fewer than HEAVY keys, are broadcast; no other key has more rows than that.
    """
    hot = F.col(weight) * HEAVY > total
    few, most = facts.where(hot).drop(weight), facts.where(~hot).drop(weight)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(most, key, "left"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows = fronts(conversations)
    words, cells = sketch(rows)
    every = stored(screened(rows, words, cells), "screened")
    discard(rows, words)
    shared, alone = every.where("open").drop("open", "parent_open"), every.where("NOT open")
    named = stored(shared.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent")), "named")
    children = named.where("parent IS NOT NULL").select(F.col("parent").alias("node")).unionByName(alone.where("parent_open").select(F.col("parent").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(named.drop("parent").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    discard(named)
    n_shared = shared.count()
    # what each conversation leaves to others, and whether it names a leaf
    owned = looked_up(shared, nodes, "node", "n", n_shared)
    mine = F.col("owner") == F.col("conv_id")
    facts = owned.select("conv_id", F.when(mine, 0).otherwise(F.col("n_chars")).alias("left"), (F.col("end") & mine & (F.col("n_children") == 0)).cast("int").alias("leaf"), F.lit(1).alias("n"))
    facts = facts.unionByName(alone.where("end").select("conv_id", F.lit(0).cast("long").alias("left"), F.lit(1).alias("leaf"), F.lit(0).alias("n")))
    convs = stored(facts.groupBy("conv_id").agg(F.sum("left").alias("left"), F.max("leaf").alias("leaf"), F.sum("n").alias("n")), "convs")
    with_convs = looked_up(shared, convs, "conv_id", "n", n_shared)
    saved = F.greatest(F.col("left") - F.col("before"), F.lit(0))
    own = with_convs.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"), F.count_if("end").alias("n_ends"), F.min(F.when(F.col("end"), F.col("conv_id"))).alias("one_end"))
    exact = stored(own.join(nodes.select("node", "n_children"), "node"), "exact")
    discard(convs)
    several = exact.where("n_ends > 1").select("node", "n_ends", F.lit(True).alias("several"))
    ended = looked_up(shared.where("end").select("node", "conv_id"), several, "node", "n_ends", n_shared).where("several").select("node.a", "node.b", "conv_id")
    hashed = ends_digests(ended).select(F.struct("a", "b").alias("node"), "sha")
    one = F.when(F.col("one_end").isNull(), EMPTY_SHA).otherwise(F.sha2(F.col("one_end").cast("string"), 256))
    cols = ["conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    known = exact.join(hashed, "node", "left").withColumn("ends_sha256", F.coalesce("sha", one)).select(*cols)
    tail = alone.select("conv_id", "depth", F.when(F.col("parent_open"), F.col("parent")).alias("parent"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("end"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("end"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY_SHA).alias("ends_sha256"))
    inside = tail.where("parent IS NULL").withColumn("owner", F.col("conv_id"))
    hung = known.unionByName(tail.where("parent IS NOT NULL"))
    parents = nodes.select(F.col("node").alias("parent"), "owner", "n_children")
    n_hung = nodes.agg(F.sum("n_children")).first()[0] or 0
    placed = looked_up(hung, parents.withColumnRenamed("n_children", "n"), "parent", "n", n_hung)
    # a front above that is proven to have one conversation is no exact node: it is that conversation's
    above = F.when(F.col("depth") > 0, F.coalesce("owner", "conv_id")).alias("parent_conv_id")
    return placed.unionByName(inside).select("conv_id", "depth", above, *cols[3:])


# --- digests of ends ---


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of up to `most` ids of one node, comma-joined; rows come sorted."""
    for batch in batches:
        a, b, ids = (np.asarray(batch[c]) for c in ("a", "b", "conv_id"))
        cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        cut = np.unique(np.concatenate([np.arange(x, y, most) for x, y in zip(cut, [*cut[1:], len(ids)])])) if len(ids) else cut
        text = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(cut, [*cut[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays([pa.array(a[cut]), pa.array(b[cut]), pa.array(ids[cut]), pa.array(text, pa.string())], names=["a", "b", "first", "ids"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order."""
    now, sha = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([sha.hexdigest()])], names=["a", "b", "sha"])

    for batch in batches:
        for a, b, ids in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ids"].to_pylist()):
            if (a, b) == now:
                sha.update(b"," + ids.encode())
                continue
            if now is not None:
                yield out()
            now, sha = (a, b), hashlib.sha256(ids.encode())
    if now is not None:
        yield out()


def ends_digests(rows: DataFrame) -> DataFrame:
    """a, b, sha: the digest of the ascending conv_ids of each (a, b)."""
    key, most = ["a", "b", "conv_id"], PIECE
    pieces = rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: _pieces(batches, most), "a long, b long, first long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_streamed, "a long, b long, sha string")
