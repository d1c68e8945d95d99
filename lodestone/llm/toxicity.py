"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Each word is the sum of hashed embeddings of itself and of its first 3 to 8 bytes; filters one, two
and three words wide slide over them, max pooling keeps each filter's best place, and a logistic
layer gives the score. The fit reads every labelled row outside the held-out fold: these rows are stored in
shards of a bounded size, a task goes over a shard in small batches, and after each pass the tasks' weights are averaged
(each embedding over the tasks that met it). Scoring is one narrow pass without a shuffle, a bounded number of words at a
time. Thresholds are calibrated for each language on the scores that each learnt row gets from a fit without its fold, drawn
towards a common one where a language has few rows. The score itself never sees language, source or id.

Defined results: null and empty texts are scored as texts without words; repeated rows are scored
each; rows with null doc_id are scored, never learnt from; a label table that is empty or has one
class gives score 0.0 everywhere; extra columns pass through `score` unless they bear its output names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, key_bitmap, release, settle, stored, text_slices, with_hit

PREFIXES = (3, 4, 5, 6, 7, 8)
WIDTHS = (1, 2, 3)
SLICE = 256 << 10  # bytes of text that are scored at once
CHUNK = 1 << 11  # words that filters run over at once
HELD = 16 << 20  # bytes of text that a task keeps as word ids, where one shard is all there is
BATCH_WORDS = 1 << 19  # words of an update, a longer text alone excepted
PARTS = 16  # parts of the embeddings that are averaged side by side
GRID = np.linspace(0.05, 0.95, 91)  # thresholds that are tried


def word_ids(words: Words, bits: int) -> np.ndarray:
    """Embedding rows of each word: one for the word, one for each of its prefixes."""
    ids = np.empty((len(words.starts), 1 + len(PREFIXES)), np.uint32)
    for j, n in enumerate((None, *PREFIXES)):
        ends = words.ends if n is None else np.minimum(words.ends, words.starts + n)
        h = words.hashes(words.starts, ends) + np.uint64((j * 0x9E3779B97F4A7C15) % (1 << 64))
        ids[:, j] = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
    return ids


def sums(groups: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of each group's rows."""
    return np.stack([np.bincount(groups, column, n) for column in rows.T], 1).astype(np.float32)


@dataclass
class Toxicity:
    """Parameters and, once fitted, the weights."""

    bits: int = 16
    dim: int = 8
    filters: int = 32
    passes: int = 2  #: over all learnt rows at least
    steps: int = 400  #: few labelled rows are passed over again until there were so many updates
    rate: float = 0.02
    batch: int = 64
    most_rows: int = 12_800  #: labelled documents of a shard, about; twice as many make two shards
    most_bytes: int = 64 << 20  #: bytes of text of a shard, about; more make more shards
    seed: int = 7
    folds: int = 3  #: fits that leave out a part of the learnt rows, for thresholds
    emb: np.ndarray | None = None
    conv: np.ndarray | None = None
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    prior: float = 0.0
    thresholds: dict = field(default_factory=dict)
    common: float = 0.5  #: threshold of any other language

    def _columns(self) -> list[tuple[int, int, int]]:
        """(width, place in the filter, first column) of each projection of a word."""
        return [(w, k, self.filters * (sum(WIDTHS[: WIDTHS.index(w)]) + k)) for w in WIDTHS for k in range(w)]

    def start(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.emb = (rng.standard_normal((1 << self.bits, self.dim)) * 0.1).astype(np.float32)
        self.conv = (rng.standard_normal((self.dim, self.filters * sum(WIDTHS))) * 0.3).astype(np.float32)
        self.bias = np.zeros(self.filters * len(WIDTHS), np.float32)
        self.out = np.append(np.abs(rng.standard_normal(self.filters * len(WIDTHS))) * 0.3, 0).astype(np.float32)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        e = self.emb.take(ids[:, 0], 0)
        for j in range(1, ids.shape[1]):
            e += self.emb.take(ids[:, j], 0)
        return e

    def maps(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each filter gives at each word; places past a text's end count as zero. ends: where texts end."""
        p, f, n = self.vectors(ids) @ self.conv, self.filters, len(ids)
        last = np.zeros(n + 1, bool)
        last[ends] = True  # a place after which another text begins
        got = np.empty((n, f * len(WIDTHS)), np.float32)
        for i, w in enumerate(WIDTHS):
            at = f * sum(WIDTHS[:i])
            m = got[:, i * f : (i + 1) * f]
            m[:] = p[:, at : at + f]
            over = np.zeros(n, bool)
            for k in range(1, min(w, n)):
                over[: n - k + 1] |= last[k : n + 1]
                part = p[k:, at + k * f : at + (k + 1) * f].copy()
                part[over[: n - k]] = 0
                m[: n - k] += part
        return got

    def maxima(self, ids: np.ndarray, splits: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's maximum in each text (0 without words), and its first place; CHUNK words are held at a time."""
        best = np.full((len(splits) - 1, self.filters * len(WIDTHS)), -np.inf, np.float32)
        place = np.zeros(best.shape, np.int64) if places else None
        for a in range(0, len(ids), CHUNK):
            b = min(a + CHUNK, len(ids))
            c = min(b + max(WIDTHS) - 1, len(ids))
            got = self.maps(ids[a:c], splits[(splits > a) & (splits <= c)] - a)[: b - a]
            t, u = np.searchsorted(splits, a, "right") - 1, np.searchsorted(splits, b)
            local = np.clip(splits[t : u + 1] - a, 0, b - a)
            full = np.flatnonzero(np.diff(local))
            top = np.maximum.reduceat(got, local[full], axis=0)
            better = top > best[t + full]
            if places:
                own = np.stack([a + s + got[s:e].argmax(0) for s, e in zip(local[full], local[full + 1])])
                place[t + full] = np.where(better, own, place[t + full])
            best[t + full] = np.where(better, top, best[t + full])
        best[np.diff(splits) == 0] = 0
        return best, place

    def logits(self, ids: np.ndarray, splits: np.ndarray) -> np.ndarray:
        pooled = self.maxima(ids, splits)[0]
        full = np.diff(splits) > 0
        pooled[full] = np.maximum(pooled[full] + self.bias, 0)
        return pooled @ self.out[:-1] + self.out[-1] + np.float32(self.prior)

    def gradients(self, ids: np.ndarray, splits: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of the mean log loss over texts, none without words: by weights; words whose vectors matter, and by their vectors.

        Gradients only flow to the place of each filter's maximum.
        """
        f = self.filters
        best, place = self.maxima(ids, splits, True)
        raw = best + self.bias
        pooled = np.maximum(raw, 0)
        g = (1 / (1 + np.exp(-np.clip(pooled @ self.out[:-1] + self.out[-1], -30, 30))) - y) / len(y)
        grad = {"out": np.append(g @ pooled, g.sum()).astype(np.float32)}
        gp = g[:, None] * self.out[:-1] * (raw > 0)
        grad["bias"] = gp.sum(0)
        grad["conv"], words, by_word = np.zeros_like(self.conv), [], []
        end = np.broadcast_to(splits[1:, None], place.shape)
        for w, k, at in self._columns():
            i = WIDTHS.index(w) * f
            pos, gg = place[:, i : i + f] + k, gp[:, i : i + f]
            use = (pos < end[:, i : i + f]) & (gg != 0)
            which, gg, pos = np.nonzero(use)[1], gg[use].astype(np.float32), pos[use]
            grad["conv"][:, at : at + f] = sums(which, self.vectors(ids[pos]) * gg[:, None], f).T
            words.append(pos)
            by_word.append(gg[:, None] * self.conv[:, at + which].T)
        return grad, np.concatenate(words), np.concatenate(by_word)

    def update(self, state: dict, ids: np.ndarray, splits: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One step on the log loss: Adam, and AdaGrad for the embeddings."""
        grad, pos, gw = self.gradients(ids, splits, y)
        state["t"] += 1
        t = state["t"]
        for k, v in grad.items():
            m, s = state[k]
            m += 0.1 * (v - m)
            s += 0.001 * (v * v - s)
            getattr(self, k)[...] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-7)
        if len(pos):
            hit = ids[pos].ravel()
            place = np.zeros(len(self.emb), np.int64)
            place[hit] = 1
            rows = np.flatnonzero(place)
            place[rows] = np.arange(len(rows))
            total = sums(place[hit], np.repeat(gw, ids.shape[1], axis=0), len(rows))
            state["seen"][rows] += total * total
            self.emb[rows] -= 2 * rate * total / np.sqrt(state["seen"][rows])

    def fresh_state(self) -> dict:
        """What update() keeps between steps, before the first one."""
        return {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in DENSE} | {"seen": np.full(self.emb.shape, 1e-4, np.float32), "t": 0}


DENSE = ("conv", "bias", "out")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def learnable(docs: DataFrame, labels: DataFrame, model: Toxicity) -> tuple[DataFrame | None, int, int, float]:
    """Every labelled document outside the held-out fold (doc_id, toxic, text, lang, fold), stored in shards of a random but fixed
    order; the number of shards, that of rows and the share of toxic ones. None where a class has no rows.

    A doc_id that stands on several rows gives its least text, and is toxic where one of its labels is. Only texts whose
    doc_id may be labelled are shuffled, once.
    """
    label = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(label.alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = stored(known, "toxicity-labels")
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        discard(known)
        return None, 0, 0, 0.0
    bits = key_bitmap(known.select("doc_id"), "doc_id", "toxicity-bits")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = docs.select("doc_id", text.alias("text"), lang.alias("lang")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = with_hit(some, bits, "doc_id").where("hit").select("doc_id", F.struct("text", "lang").alias("r"))
    size = some.agg(F.count(F.lit(1)), F.sum(F.octet_length("r.text"))).first()
    shards = max(1, int(size[0]) // model.most_rows, -(-int(size[1] or 0) // model.most_bytes))
    both = some.withColumn("toxic", F.lit(None).cast("int")).unionByName(known.withColumn("r", F.lit(None).cast(some.schema["r"].dataType)))
    one = both.repartition(shards, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("r").alias("r")).where("toxic IS NOT NULL AND r IS NOT NULL")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(model.seed), F.lit("fold")), F.lit(max(model.folds, 1))).cast("int")
    order = F.xxhash64(F.col("doc_id"), F.lit(model.seed))
    rows = stored(one.coalesce(shards).sortWithinPartitions(order, "doc_id").select("doc_id", "toxic", "r.text", "r.lang", fold.alias("fold")), "toxicity-rows")
    discard(known, bits.words)
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        discard(rows)
        return None, 0, 0, 0.0
    return rows, shards, sum(counts.values()), counts[1] / sum(counts.values())


def fit_toxicity(docs: DataFrame, labels: DataFrame, model: Toxicity | None = None) -> Toxicity:
    """Fit on every labelled document outside the held-out fold; each language's threshold is set by scores of fits that leave
    out a fold of these."""
    model = model or Toxicity()
    rows, shards, n, true = learnable(docs, labels, model)
    if rows is None:
        return model
    folds = model.folds if min(true, 1 - true) * n > model.folds - 0.5 else 0
    passes = max(model.passes, -(-model.steps * model.batch * shards // n))
    held = shards == 1 and rows.agg(F.sum(F.octet_length("text"))).first()[0] <= HELD
    model.start()
    fits = [(copied(model), model.fresh_state()) for _ in range(folds + 1)]
    for at in range(0, passes, passes if held else 1):
        fits = one_round(rows, fits, range(at, passes if held else at + 1), passes)
    own = fits[-1][0]
    if folds:
        own.thresholds, own.common = least_errors(out_of_fold(rows, [m for m, _ in fits[:-1]]), true)
    discard(rows)
    release()
    return own


def copied(m: Toxicity) -> Toxicity:
    """A model of the same settings and weights, which are its own."""
    out = Toxicity(**{k: v for k, v in vars(m).items() if k != "thresholds"})
    for k in ("emb", *DENSE):
        setattr(out, k, getattr(m, k).copy())
    return out


def word_batches(batches: Iterator[pa.RecordBatch], m: Toxicity, leave: int, passes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """pass, word ids, splits and labels of each update: rows of the fold `leave` are left out. Several passes hold the ids."""
    kind = np.uint16 if m.bits <= 16 else np.uint32
    empty = np.zeros((1, 1 + len(PREFIXES)), kind)

    def texts() -> Iterator[tuple[np.ndarray, int]]:
        for i, batch in enumerate(batches):
            mixed = batch.take(pa.array(np.random.default_rng((m.seed, passes[0], i)).permutation(len(batch))))
            for part, data, offsets in text_slices(mixed, "text", SLICE):
                w = Words(data, offsets)
                ids = word_ids(w, m.bits).astype(kind)
                for toxic, fold, a, b in zip(part["toxic"].to_pylist(), part["fold"].to_pylist(), w.splits[:-1], w.splits[1:]):
                    if fold != leave:
                        yield ids[a:b] if b > a else empty, toxic

    def cut(rows: Iterator[tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        some, words = [], 0
        for row in rows:
            if some and (len(some) == m.batch or words + len(row[0]) > BATCH_WORDS):
                yield joined(some)
                some, words = [], 0
            some.append(row)
            words += len(row[0])
        if some:
            yield joined(some)

    if len(passes) == 1:
        yield from ((passes[0], *b) for b in cut(texts()))
        return
    kept = [(ids.copy(), toxic) for ids, toxic in texts()]
    for p in passes:
        yield from ((p, *b) for b in cut(kept[i] for i in np.random.default_rng((m.seed, p)).permutation(len(kept))))


def joined(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([r[0] for r in rows]), np.append(0, np.cumsum([len(r[0]) for r in rows])), np.array([r[1] for r in rows], np.float32)


def one_round(rows: DataFrame, fits: list[tuple[Toxicity, dict]], passes: range, of: int) -> list[tuple[Toxicity, dict]]:
    """The fits after further passes: a task for each shard and fit, then the means of what these tasks changed.

    Fit k leaves out fold k, the last one none. An embedding's change is the mean over the tasks that changed it, weighted by how
    much each saw of it; other weights count by the tasks' updates. What travels is of the model's size for each shard of rows.
    """
    spark, last = rows.sparkSession, len(fits) - 1
    shared = spark.sparkContext.broadcast(fits)  # of a size fixed by bits, dim, filters and folds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        while first is not None and not len(first):
            first = next(batches, None)
        if first is None:
            return
        k = first["fit"][0].as_py()
        start, begun = shared.value[k]
        m = copied(start)
        state = {x: (begun[x][0].copy(), begun[x][1].copy()) for x in DENSE} | {"seen": begun["seen"].copy(), "t": begun["t"]}
        for p, ids, splits, y in word_batches(itertools.chain([first], batches), m, -1 if k == last else k, passes):
            m.update(state, ids, splits, y, m.rate / (1 + DECAY * p / of))
        who, out = TaskContext.get().partitionId(), []
        met = np.flatnonzero((state["seen"] != begun["seen"]).any(1))
        part = met * PARTS >> m.bits
        for i in range(PARTS):
            at = met[part == i]
            if len(at):
                out.append((k, i, who, 0.0, at.astype("<i4").tobytes(), (m.emb[at] - start.emb[at]).tobytes(), (state["seen"][at] - begun["seen"][at]).tobytes()))
        dense = np.concatenate([a.ravel() for x in DENSE for a in (getattr(m, x), *state[x])]).astype(np.float32)
        out.append((k, PARTS, who, float(state["t"] - begun["t"]), b"", dense.tobytes(), b""))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHANGES)], schema=_CHANGES)
        release()

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("who")  # sums do not hang on the order of arrival
        rows = table.to_pylist()
        dim = shared.value[0][0].dim
        if key[1].as_py() == PARTS:
            weight = np.array([r["weight"] for r in rows])
            total = sum(w * np.frombuffer(r["change"], np.float32).astype(np.float64) for w, r in zip(weight, rows)) / max(weight.sum(), 1e-9)
            got = (b"", total.astype(np.float32).tobytes(), b"", float(weight.max()))
        else:
            at = np.unique(np.concatenate([np.frombuffer(r["at"], "<i4") for r in rows]))
            num, den, times = np.zeros((len(at), dim)), np.zeros((len(at), dim)), np.zeros((len(at), 1))
            for r in rows:
                i = np.searchsorted(at, np.frombuffer(r["at"], "<i4"))
                saw = np.frombuffer(r["seen"], np.float32).reshape(-1, dim).astype(np.float64)
                num[i] += np.frombuffer(r["change"], np.float32).reshape(-1, dim) * saw
                den[i] += saw
                times[i] += 1
            got = (at.astype("<i4").tobytes(), (num / np.maximum(den, 1e-30)).astype(np.float32).tobytes(), (den / times).astype(np.float32).tobytes(), 0.0)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [0], [got[3]], [got[0]], [got[1]], [got[2]]], schema=_CHANGES)

    each = rows.select("toxic", "text", "fold")
    todo = each.withColumn("fit", F.lit(0))
    for k in range(1, len(fits)):
        todo = todo.unionByName(each.withColumn("fit", F.lit(k)))
    kinds = "fit int, part int, who int, weight double, at binary, change binary, seen binary"
    done = stored(todo.mapInArrow(run, kinds).groupBy("fit", "part").applyInArrow(mean, kinds), "toxicity-changes")
    shared.destroy()
    settle(spark)
    for r in done.toLocalIterator():  # of the size of the models, a part of them at a time
        m, state = fits[r["fit"]]
        change = np.frombuffer(r["change"], np.float32)
        if r["part"] < PARTS:
            at = np.frombuffer(r["at"], "<i4")
            m.emb[at] += change.reshape(-1, m.dim)
            state["seen"][at] += np.frombuffer(r["seen"], np.float32).reshape(-1, m.dim)
            continue
        begin = 0
        for x in DENSE:
            for a in (getattr(m, x), *state[x]):
                a[...] = change[begin : begin + a.size].reshape(a.shape)
                begin += a.size
        state["t"] += int(r["weight"])
    discard(done)
    return fits


DECAY = 6  # the rate falls to a seventh by the last pass
_CHANGES = pa.schema([("fit", pa.int32()), ("part", pa.int32()), ("who", pa.int32()), ("weight", pa.float64()), ("at", pa.binary()), ("change", pa.binary()), ("seen", pa.binary())])


def out_of_fold(rows: DataFrame, models: list[Toxicity]) -> dict[str, np.ndarray]:
    """For each language, how many learnt rows of each label have a score from each of GRID's values up to the next, by the fit
    without their fold."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", SLICE):
                w, fold, x = Words(data, offsets), np.asarray(part["fold"]), np.zeros(len(part), np.float32)
                ids, n = word_ids(w, shared.value[0].bits), np.diff(w.splits)
                for k, m in enumerate(shared.value):
                    own = fold == k
                    x[own] = m.logits(ids[np.repeat(own, n)], np.append(0, np.cumsum(n[own])))
                at = np.searchsorted(GRID, 1 / (1 + np.exp(-x.astype(np.float64))), "right")
                yield pa.RecordBatch.from_arrays([part["lang"], part["toxic"], pa.array(at, pa.int32())], names=["lang", "toxic", "at"])

    counts: dict[str, np.ndarray] = {}
    for r in rows.select("lang", "toxic", "text", "fold").mapInArrow(run, "lang string, toxic int, at int").groupBy("lang", "toxic", "at").count().collect():  # up to 184 a language
        counts.setdefault(r["lang"] or "", np.zeros((2, len(GRID) + 1), np.int64))[r["toxic"], r["at"]] += r["count"]
    shared.destroy()
    return counts


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list, true: float, weight: int = 20) -> tuple[dict, float]:
    """least_errors() of rows."""
    names, at = np.array(["" if x is None else x for x in langs]), np.searchsorted(GRID, scores, "right")
    counts = {n: np.stack([np.bincount(at[(names == n) & (y == label)], minlength=len(GRID) + 1) for label in (0, 1)]) for n in set(names.tolist())}
    return least_errors(counts, true, weight)


def least_errors(counts: dict[str, np.ndarray], true: float, weight: int = 20) -> tuple[dict, float]:
    """For each language the threshold nearest to 0.5 whose error is within a standard error of the least, and the one for
    any other language. `counts` has the rows of each label by how many of GRID's values their score reaches.

    The error is a language's own rate and that of all rows together, which counts as much as `weight` rows of its rarer class.
    """

    def errors(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By threshold: the error, and its variance (of counts, none taken as certain)."""
        w1, w0 = true / max(c[1].sum(), 1), (1 - true) / max(c[0].sum(), 1)
        missed = np.cumsum(c[1])[:-1]
        alarms = c[0].sum() - np.cumsum(c[0])[:-1]
        return w1 * missed + w0 * alarms, w1**2 * (missed + 1) + w0**2 * (alarms + 1)

    def least(loss: np.ndarray, variance: np.ndarray) -> float:
        best = int(loss.argmin())
        return float(min(GRID[loss <= loss[best] + variance[best] ** 0.5], key=lambda g: (round(abs(g - 0.5), 6), g)))

    out = {}
    loss, variance = errors(sum(counts.values()))
    for lang, own_counts in sorted(counts.items()):
        rarer = own_counts.sum(1).min()
        share = rarer / (rarer + weight) if rarer else 0.0
        own, spread = errors(own_counts)
        out[lang] = least(share * own + (1 - share) * loss, share**2 * spread + (1 - share) ** 2 * variance)
    return out, least(loss, variance)


def scored(docs: DataFrame, model: Toxicity, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns `keep`, all by default), score, predicted, threshold (of the row's language), flagged.

    A text travels to the worker once, within the row where that has it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size fixed by bits, dim and filters
    keep = keep or docs.columns
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    inside = "text" in keep and dict(docs.dtypes)["text"] == "string"
    text = [] if inside else [F.col("text").cast("string").alias("text")]
    src = docs.select(F.struct(*keep).alias("row"), lang.alias("lang"), *text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("row"))
            texts = rows.field("text") if inside else batch.column(batch.schema.get_field_index("text"))
            langs, done = batch.column(batch.schema.get_field_index("lang")).to_pylist(), 0
            for part, data, offsets in text_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE):
                w = Words(data, offsets)
                x = m.logits(word_ids(w, m.bits), w.splits) if m.emb is not None else np.full(len(part), -np.inf)
                s = 1 / (1 + np.exp(-x.astype(np.float64)))
                th = np.array([m.thresholds.get(v or "", m.common) for v in langs[done : done + len(part)]], np.float64)
                yield pa.RecordBatch.from_arrays([rows.slice(done, len(part)), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(th), pa.array(s >= th)], names=["row", "score", "predicted", "threshold", "flagged"])
                done += len(part)

    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("flagged", T.BooleanType())])
    return src.mapInArrow(run, schema)


def score(docs: DataFrame, model: Toxicity, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) but those named like these, with score, predicted, threshold and flagged."""
    made = ["score", "predicted", "threshold", "flagged"]
    keep = [c for c in (keep or docs.columns) if c not in made]
    return scored(docs, model, keep).select("row.*", *made)
