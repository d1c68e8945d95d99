"""Prefix tries, token counts and clusters against brute force, and their odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import prefix_trie, subvectors, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


# --- prefix trie ---


def trie_by_hand(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], set()).add(c)
    out = []
    for front, who in members.items():
        below = [f for f in members if f[: len(front)] == front]
        kids = [f for f in below if len(f) == len(front) + 1]
        leaves = [f for f in below if not any(len(g) == len(f) + 1 and g[: len(f)] == f for g in members)]
        saved = sum((len(members[f]) - 1) * len(f[-1][1]) for f in below if f)
        ends = ",".join(str(c) for c in sorted(c for c in who if built[c] == front))
        out.append((min(who), len(front), min(members[front[:-1]]) if front else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in prefix_trie.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def conversations(seed, n, texts=3, turns=7):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-120, 420), n):
        rows += [(c, t if rnd.random() > 0.1 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["", None, *"abcdefgh"[:texts]]) if rnd.random() > 0.1 else "x" * rnd.randint(1, 90)) for t in range(rnd.randint(1, turns))]
    copies = [(500 + k, t, "user", f"long copied text {t}") for k in range(25) for t in range(9)]
    return rows + copies + rows[:5] + [(None, 1, "user", "no id")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force(spark, seed):
    rows = conversations(seed, 60, texts=2 + seed)
    assert trie_rows(spark.createDataFrame(rows, SCHEMA).repartition(3)) == trie_by_hand(rows)


def test_trie_with_a_sketch_that_is_too_small(spark, monkeypatch):
    """Estimates above one for nearly all fronts: more is grouped exactly, and the result is the same."""
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", 64)
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", 64)
    rows = conversations(3, 40)
    assert trie_rows(spark.createDataFrame(rows, SCHEMA)) == trie_by_hand(rows)


def test_trie_without_heavy_keys_and_small_pieces(spark, monkeypatch):
    """The broadcast of heavy keys, and ids hashed piece by piece."""
    monkeypatch.setattr(prefix_trie, "HEAVY", 10)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = conversations(4, 40)
    assert trie_rows(spark.createDataFrame(rows, SCHEMA)) == trie_by_hand(rows)


def test_trie_of_a_conversation_that_spans_partitions(spark):
    rows = [(7, t, "user", f"t{t % 5}") for t in range(400)] + [(9, t, "user", f"t{t % 5}") for t in range(400)] + [(8, 0, "user", "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_rows(spark.createDataFrame(rows, SCHEMA).repartition(4)) == trie_by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_odd_tables(spark):
    assert trie_rows(spark.createDataFrame([], SCHEMA)) == []
    rows = [(3, None, None, None)]
    got = trie_rows(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("end", F.lit("x")).withColumn("pid", F.lit(0)))
    assert got == trie_by_hand(rows)


def test_running_sums_over_batches(spark):
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    ids = np.sort(rnd.integers(0, 6, 60))
    cols = {"conv_id": ids, "pid": np.zeros(60, np.int32), "n_chars": rnd.integers(0, 9, 60), **{c: rnd.integers(0, prefix_trie.PRIME, 60) for c in prefix_trie.LANES}}
    whole = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})
    one = pa.Table.from_batches(prefix_trie._running(iter([whole]))).to_pydict()
    for sizes in ([7] * 9, [1] * 60, [30, 30]):
        edges = np.minimum(np.append(0, np.cumsum(sizes)), 60)
        parts = [whole.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:])]
        assert pa.Table.from_batches(prefix_trie._running(iter(parts))).to_pydict() == one
    for i in range(60):
        mine = [j for j in range(i + 1) if ids[j] == ids[i]]
        assert one["at"][i] == len(mine) and one["upto"][i] == cols["n_chars"][mine].sum()
        assert one["q1"][i] == sum(int(cols["h1"][j]) * pow(prefix_trie.BASES[1], k + 1, prefix_trie.PRIME) for k, j in enumerate(mine)) % prefix_trie.PRIME


# --- token counts ---

ODD = ["", " ", "it's we're they'll I'd 'r 'l 'rx 'l l's  x", "a  b\n\n c\t'd", " 's 's's'ss", "<|endoftext|>", "x<|endoftext|>  y <|endoftext|><|endoftext|>", "aaaa" * 50, "  <|endoftext|>  '", "'r<|endoftext|>", "　　x 日本語", "🎉 é́ a\u0085b", "Ã" * 90]


def samples(n, seed=1):
    rnd = random.Random(seed)
    kinds = ["abcdefghij klmnopqrstuvwxyz ", " '\n\tslrevtmd", "ab", "0123456789., ", "éàüñßøÃÂ ", "日本語 한국어　", "=-_*#/\\ \n", "<|endoftext|> a"]
    for _ in range(n):
        k = rnd.choice(kinds)
        yield "".join(rnd.choice(k) for _ in range(rnd.randint(0, 90)))
    for _ in range(n // 4):
        yield "".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0, 0x2FF), rnd.randint(0, 0xD7FF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(rnd.randint(0, 40)))


def test_counts_are_the_librarys(monkeypatch):
    text = open(FILE, encoding="utf-8").read()
    merges, library = token_counts.Merges(text, token_counts.classes()), token_counts._library(text)
    texts = [*ODD, *samples(2000), *["x" * k + "'r" for k in range(60, 70)], *["x" * k + " 'l" for k in range(120, 130)]]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert merges.counts(data, offsets).tolist() == want
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    merges.forget_states()
    merges.words = {}
    assert merges.counts(data, offsets).tolist() == want
    assert merges.count(b"ab" * 9000) == len(library.encode("ab" * 9000, add_special_tokens=False))
    monkeypatch.setattr(token_counts, "BLOCK", 3000)
    whole = "".join(t.replace("<|endoftext|>", "<|end") for t in texts)
    assert merges.counts(np.frombuffer(whole.encode(), np.uint8), np.array([0, len(whole.encode())])).tolist() == [len(library.encode(whole, add_special_tokens=False))]


def test_prefix_scan_composes_in_order():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 13):
        maps = rnd.integers(0, 5, (n, 5)).astype(np.uint8)
        now = np.arange(5)
        for row, got in zip(maps, token_counts.prefix_scan(maps)):
            now = row[now]
            assert got.tolist() == now.tolist()


def test_token_counts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "Hello <|endoftext|>"), (3, "Hello <|endoftext|>"), (4, "word " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, FILE, check_one_in=1).collect()), key=str)
    lib = token_counts._library(open(FILE, encoding="utf-8").read())
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in rows]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), FILE).count() == 0


def test_token_counts_read_no_other_files():
    with pytest.raises(ValueError):
        token_counts.Merges(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), token_counts.classes())


# --- clusters ---


def clusters_by_hand(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    v = np.array([x for _, x in kept], object)
    c = [np.array(x, object) for _, x in sorted(kept, key=key)[:k]]
    near = lambda: [min((int(((x - y) ** 2).sum()), j) for j, y in enumerate(c)) for x in v]
    for _ in range(rounds):
        a = [j for _, j in near()]
        c = [np.array([sum(v[i][d] for i in range(len(v)) if a[i] == j) // a.count(j) for d in range(64)], object) if j in a else c[j] for j in range(len(c))]
    a = near()
    own = {j: sum(d for d, i in a if i == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, own[j], sum(d for d, _ in a), sha[j]) for (i, _), (d, j) in zip(kept, a)), key=str)


@pytest.mark.parametrize("spread,segment", [(1.0, 64), (0.002, 32), (0.002, 4096)])
def test_clusters_are_those_of_brute_force(spark, spread, segment):
    """Spread decides how often subvectors repeat, so blocks of one dimension and of eight."""
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rnd.normal(0, spread, 64) + (i % 7) * 0.01)]) for i in range(90)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(5, rows[3][1]), (None, rows[4][1])]
    rows += [(300, None), (301, [1.0] * 63), (302, [None] + [1.0] * 63), (303, [float("nan")] * 64), (304, [float("inf")] * 64), (305, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in subvectors.with_inertia(*subvectors.clusters(df, segment=segment)).collect()), key=str)
    assert got == clusters_by_hand(rows)


def test_segments_are_coded_without_loss():
    rnd = np.random.default_rng(3)
    for v, width in ((rnd.integers(-2, 2, (50, 64)), 1), (np.repeat(rnd.integers(-900, 900, (5, 64)), 20, 0), 8), (rnd.integers(-(1 << 27), 1 << 27, (30, 64)), 1)):
        s = subvectors.Segment(v)
        entries, codes = s.parts()
        back = subvectors.Segment(None, {"n": len(v), "width": s.width, "entries": entries, "codes": codes})
        assert s.width == width and (np.concatenate([e[c] for e, c in zip(back.entries, back.codes)], 1) == v).all()


def test_clusters_of_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert subvectors.with_inertia(*subvectors.clusters(empty)).count() == 0
    few = [(i, [float(i)] * 64) for i in range(3)]
    got = sorted((tuple(r) for r in subvectors.with_inertia(*subvectors.clusters(spark.createDataFrame(few, empty.schema))).collect()), key=str)
    assert got == clusters_by_hand(few)
    with pytest.raises(Exception, match="beyond"):
        subvectors.clusters(spark.createDataFrame([(1, [1e9] * 64)], empty.schema))
