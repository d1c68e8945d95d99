"""Posting blocks, the vector index and walks for many queries, each against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, postings, vectors

CHUNKS = "path string, ordinal int, start_line int, end_line int, text string"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abAé") for _ in range(rnd.randint(1, 5))) for _ in range(n))


def some_chunks(n=120, seed=1):
    rnd = random.Random(seed)
    rows = [(f"src/{words(rnd, 1)}{i % 40}.ts", i // 40, 1 + i // 40, 2, words(rnd, rnd.randint(0, 60))) for i in range(n)]
    return [*rows, ("none", 0, 1, 1, None), ("x", 0, 1, 1, "aaaa aaa"), ("q/aaa.ts", 0, 1, 1, "a\U0001f600b a\U0001f600b")]


def occurrences(text, term):
    return sum(text.startswith(term, i) for i in range(len(text)))


def by_hand(rows, terms):
    f = {t: [2 * occurrences(p.lower(), t) + occurrences((x or "").lower(), t) for p, *_, x in rows] for t in terms}
    d = [2 * max(len(p) - 2, 0) + max(len(x or "") - 2, 0) for p, *_, x in rows]
    mean, out = sum(d) / len(d), []
    for i, (path, ordinal, line, *_) in enumerate(rows):
        s = 0.0
        for t in terms:
            n = sum(x > 0 for x in f[t])
            if f[t][i]:
                raw = math.log((len(rows) - n + 0.5) / (n + 0.5))
                s -= (raw if raw > 0 else 1e-6) * f[t][i] * 2.2 / (f[t][i] + 1.2 * (0.25 + 0.75 * d[i] / mean))
        if any(f[t][i] for t in terms):
            out.append((round(s, 6), path, line, ordinal))
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_search_is_that_of_brute_force(spark, k):
    rows = some_chunks()
    index = postings.build(spark.createDataFrame(rows, CHUNKS).repartition(3), shard=7)
    sets = {"1": ["aba", "bab"], "2": ["aaa"], "3": ["abaab", "éaa"], "4": ["zzz"], "5": ["src", "aab"], "6": ["a\U0001f600b"], "7": []}
    asked = spark.createDataFrame(list(sets.items()), "query_id string, terms array<string>")
    got = index.docs.join(postings.search(index, asked, k), "number").collect()
    for q, terms in sets.items():
        mine = sorted((r.score, r.path, r.start_line, r.ordinal) for r in got if r.query_id == q)
        want = by_hand(rows, terms)[:k]
        assert [m[1:] for m in mine] == [w[1:] for w in want] and [m[0] for m in mine] == pytest.approx([w[0] for w in want], abs=2e-6)


@pytest.mark.parametrize("k", [5, 1000])
def test_search_of_places_apart_is_that_of_brute_force(spark, monkeypatch, k):
    """str.count takes places as replace() does: one that overlaps the one before is not counted."""
    rows = [*some_chunks(), ("long", 0, 1, 1, "a" * 5000 + " ababab " + "a" * 4), ("abababa/aaaaa.ts", 0, 1, 1, "abababa")]
    index = postings.build(spark.createDataFrame(rows, CHUNKS).repartition(3), shard=7)
    sets = {"1": ["aba", "bab"], "2": ["aaa"], "3": ["abaab", "éaa"], "4": ["ababa", "aaaa"]}
    asked = spark.createDataFrame(list(sets.items()), "query_id string, terms array<string>")
    got = index.docs.join(postings.search(index, asked, k, apart=True), "number").collect()
    every = by_hand(rows, ["aaa"])
    monkeypatch.setitem(globals(), "occurrences", str.count)
    assert by_hand(rows, ["aaa"]) != every
    for q, terms in sets.items():
        mine = sorted((r.score, r.path, r.start_line, r.ordinal) for r in got if r.query_id == q)
        want = by_hand(rows, terms)[:k]
        assert [m[1:] for m in mine] == [w[1:] for w in want] and [m[0] for m in mine] == pytest.approx([w[0] for w in want], abs=2e-6)


def test_matches_are_all_chunks_with_a_term(spark):
    rows = some_chunks(seed=3)
    index = postings.build(spark.createDataFrame(rows, CHUNKS), shard=7)
    got = index.docs.join(postings.matching(index, {"s": ["abab", "aaa"], "t": ["ab"], "u": ["none"]}), "number").collect()
    want = lambda ts: {(p, o) for p, o, *_, x in rows if any(t in p.lower() or t in (x or "").lower() for t in ts)}
    assert {(r.path, r.ordinal) for r in got if r["set"] == "s"} == want(["abab", "aaa"]) and {(r.path, r.ordinal) for r in got if r["set"] == "u"} == want(["none"])
    assert not [r for r in got if r["set"] == "t"]


def test_blocks_that_cannot_match_are_not_read(spark):
    """Of a term whose rare trigram is in one shard, only that shard's places are decoded; files without its trigrams stay shut."""
    rows = [(f"f{i:03}", 0, 1, 1, "common words everywhere" + (" zebra" if i == 50 else "")) for i in range(140)]
    index = postings.build(spark.createDataFrame(rows, CHUNKS), shard=7)
    n_shards = index.blocks.where("gram = -1").count()
    assert n_shards >= 20
    seen = postings.hits(index, ["zebra", "everywherezebra"]).agg(F.sum("seen").alias("seen"), F.sum("read").alias("read")).first()
    assert seen["seen"] > n_shards and seen["read"] == 3
    wanted = set(postings.gram_codes("zebra"))
    opened = {r.f for r in postings.blocks_of(index, wanted).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(opened) <= len(wanted) and len(postings.blocks_of(index, wanted).inputFiles()) < max(2, len(index.files))


def test_an_index_is_opened_again(spark, tmp_path):
    rows = some_chunks(20)
    path = str(tmp_path / "index")
    postings.build(spark.createDataFrame(rows, CHUNKS), path)
    index = postings.opened(spark, path)
    asked = spark.createDataFrame([("1", ["aba"])], "query_id string, terms array<string>")
    assert postings.search(index, asked, 50).count() == len(by_hand(rows, ["aba"])) and index.n == len(rows)
    empty = postings.build(spark.createDataFrame([], CHUNKS))
    assert postings.search(empty, asked, 5).count() == 0 and postings.matching(empty, {"s": ["aba"]}).count() == 0
    with pytest.raises(ValueError):
        postings.search(index, asked, 0)


def test_codes_of_numbers():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 + 5, 2**34])
    data, end = postings.coded(v)
    assert (postings.decoded(data.tobytes()) == v).all() and end[-1] == len(data) and len(postings.decoded(b"")) == 0


# --- vectors ---


def near_by_hand(rows, asked, k):
    out = []
    for q, w in asked:
        d = sorted((round(math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(v, w))), 9), i) for i, v in rows)
        out += [(q, n + 1, i, x) for n, (x, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_are_those_of_brute_force(spark, clustered):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(0, 5, (12, 6))
    rows = [(i, [float(x) for x in np.float32((centres[i % 12] if clustered else 0) + rnd.normal(0, 0.3, 6))]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties, cut by id
    odd = [(2000, None), (2001, [1.0] * 5), (2002, [float("nan")] * 6), (2003, [None] * 6)]
    df = spark.createDataFrame(rows + odd, "id long, v array<float>").repartition(4)
    index = vectors.build(df, ["id"], "v", 6, clusters=12)
    assert index.n.sum() == len(rows)
    asked = rows[:30:3] + [(7000, [0.0] * 6)]
    queries = spark.createDataFrame(asked + [(7001, [1.0] * 5), (7002, None)], "query_id long, vector array<float>")
    near, met = vectors.nearest(index, queries, 7)
    got = sorted((r.query_id, r.position, r.id, r.distance) for r in near.collect())
    want = near_by_hand(rows, asked, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-9)
    shares = [r.share for r in met.collect()]
    assert len(shares) == len(asked) and (not clustered or sum(shares) / len(shares) < 0.3)


def test_approximate_answers_find_most(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rnd.normal(0, 1, 8)]) for i in range(900)]
    index = vectors.build(spark.createDataFrame(rows, "id long, v array<double>"), ["id"], "v", 8)
    probes = vectors.probes_for(index, 10, 0.9)
    assert 1 <= probes < len(index.centroids)
    asked = spark.createDataFrame([(i, [float(x) for x in rnd.normal(0, 1, 8)]) for i in range(60)], "query_id int, vector array<double>")
    exact, _ = vectors.nearest(index, asked, 10)
    near, met = vectors.nearest(index, asked, 10, probes=probes)
    hits = exact.join(near, ["query_id", "id"], "left_semi").count()
    assert hits >= 0.9 * 600 and met.agg(F.max("share")).first()[0] < 1


def test_vector_index_of_odd_tables(spark):
    empty = vectors.build(spark.createDataFrame([], "id long, v array<float>"), ["id"], "v", 4)
    asked = spark.createDataFrame([(1, [1.0] * 4)], "query_id int, vector array<double>")
    assert vectors.nearest(empty, asked, 3)[0].count() == 0 and vectors.probes_for(empty, 3) == 1
    one = vectors.build(spark.createDataFrame([(1, [1.0] * 4)], "id long, v array<float>"), ["id"], "v", 4)
    assert [(r.id, r.distance) for r in vectors.nearest(one, asked, 3)[0].collect()] == [(1, 0.0)]
    with pytest.raises(ValueError):
        vectors.nearest(one, asked, 0)


# --- walks ---


def walk_by_hand(deps, seeds, depth, most, each, role):
    """The queue of files, first by depth, role and order of coming."""
    into = {}
    for p, s, line, to in deps:
        if to:
            into.setdefault(to, []).append((p, line))
    queue, seen, out, order = [(0, role(p), i, p, None) for i, p in enumerate(seeds)], set(), [], len(seeds)
    while queue and len(out) < most:
        queue.sort(key=lambda x: (x[0], x[1], x[2], x[3]))
        d, _, _, p, via = queue.pop(0)
        if p in seen:
            continue
        seen.add(p)
        out.append((p, d, via))
        if d >= depth:
            continue
        own = [to for _, _, to in sorted((line, s, to) for q, s, line, to in deps if q == p)[:each]]
        near = [x for x in own if x] + [q for q, _ in sorted(into.get(p, []))[:each]]
        for x in sorted(near, key=role):
            if x not in seen and all(x != q[3] for q in queue):
                queue.append((d + 1, role(x), order, x, p))
                order += 1
    return out


def test_walks_are_those_of_a_queue(spark):
    rnd = random.Random(8)
    files = [f"s{i}.ts" for i in range(14)] + [f"s{i}.test.ts" for i in range(5)] + [f"docs/d{i}.md" for i in range(4)] + ["hub.ts"]
    role = lambda p: 2 if ".test." in p else 1 if p.startswith("docs/") else 0
    deps = list({(p, f"i{n}"): (p, f"i{n}", rnd.randint(1, 9), rnd.choice([*files, None, "hub.ts"])) for p in files for n in range(rnd.randint(0, 4))}.values())
    deps = [d for d in deps if d[0] != d[3]]
    resolved = spark.createDataFrame(deps, "path string, specifier string, line int, resolved_path string")
    asked = {f"q{i}": rnd.sample(files, rnd.randint(1, 3)) + (["unknown.ts"] if i == 3 else []) for i in range(12)}
    seeds = spark.createDataFrame([(q, p, i) for q, ps in asked.items() for i, p in enumerate(ps)], "query_id string, path string, order int")
    for depth, most, each in ((0, 5, 3), (1, 6, 2), (3, 9, 3)):
        got = graph.walks(resolved, seeds, depth, most, each).orderBy("query_id", "position").collect()
        for q, ps in asked.items():
            assert [(r.path, r.depth, r.via) for r in got if r.query_id == q] == walk_by_hand(deps, ps, depth, most, each, role), (q, depth)
    with pytest.raises(ValueError):
        graph.walks(resolved, seeds, -1, 3)


def test_a_build_writes_no_texts_and_no_shard_twice(spark, tmp_path):
    """Besides blocks only the small list of facts is written; a shard has one block of a trigram, all in one file."""
    path = f"{tmp_path}/index"
    index = postings.build(spark.createDataFrame(some_chunks(), CHUNKS).repartition(3), path, shard=7)
    assert {p.name for p in tmp_path.joinpath("index").iterdir()} == {"blocks", "facts"}
    files = index.blocks.withColumn("file", F.input_file_name()).groupBy("shard").agg(F.count_distinct("file").alias("n"), F.count_distinct("gram").alias("grams"), F.count(F.lit(1)).alias("blocks")).collect()
    assert files and all(r.n == 1 and r.grams == r.blocks for r in files)


def test_a_vector_is_made_once_for_an_index(spark):
    """The index passes over its rows several times; what makes their vectors runs once a row."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(300)], "id long, v array<double>")
    assert int(vectors.build(rows.mapInArrow(run, rows.schema), ["id"], "v", 2).n.sum()) == 300 and made.value == 300


@pytest.mark.parametrize("n", [1, 40, 399, 400, 900])
def test_drawn_rows_are_those_of_the_smallest_hashes(spark, n):
    rows = spark.range(400).select("id", F.array(F.col("id").cast("double")).alias("vector")).repartition(8)
    want = [r.vector for r in rows.orderBy(F.xxhash64("id")).limit(n).collect()]
    assert vectors.drawn_rows(rows, F.xxhash64("id"), 400, n) == want
    assert vectors.drawn_rows(rows, F.xxhash64("id"), 4_000_000, n) == want  # a cut that is much too low is widened
