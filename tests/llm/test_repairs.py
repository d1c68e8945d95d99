"""Later mentions of found names, countries and address ranges, retried batches, long URLs and the filter's error rates."""

import re
import time

from pyspark.sql import functions as F

from lodestone.llm import common, components, jaccard_join, stream_dedup, surrogates, toxicity, url_filter


def replaced(spark, texts):
    rows = surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [r.text for r in rows]


def test_found_names_are_replaced_wherever_they_stand(spark):
    texts = [
        "Mr. John Smith called. Later John Smith left; Smith was tired, and Smith's dog, and SMITH-free Smithson.",
        "Smith alone has no title here, John neither.",
        "Mrs. Smith and Mr. Alex Brown met Mrs. Alex Grey. Alex Brown and Grey went. A smith did not.",
        "Mr. Smith's house is Smith’s; Smith-Jones, O'Smith and _Smith stay.",
    ]
    got = replaced(spark, texts)
    first, family = re.match(r"Mr\. (\w+) (\w+) called", got[0]).groups()
    assert got[0] == f"Mr. {first} {family} called. Later {first} {family} left; {family} was tired, and {family}'s dog, and {family}-free Smithson."
    assert got[1] == texts[1]
    same, alex, brown, other, grey = re.match(r"Mrs\. (\w+) and Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\.", got[2]).groups()
    assert same == family and got[2].endswith(f" {alex} {brown} and {grey} went. A smith did not.") and len({alex, brown, other, grey}) == 4
    assert got[3] == f"Mr. {family}'s house is {family}’s; {family}-Jones, O'{family} and _Smith stay."


def test_kinds_go_by_row(spark):
    rows = [(1, "a@b.org"), (1, "call 555-123-4567"), (None, "c@d.org"), (None, "card 4111 1111 1111 1111"), (None, "c@d.org"), (2, None)]
    got = surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.kinds) for r in got) == [(0, "card"), (0, "email"), (0, "email"), (1, "email"), (1, "phone"), (2, "")]
    assert len({r.text for r in got if r.doc_id is None and r.kinds == "email"}) == 1


def test_countries_ranges_and_scripts_stay(spark):
    ips = ["10.0.0.1", "127.0.0.1", "192.168.4.5", "172.20.1.1", "172.40.1.1", "8.8.8.8"]
    got = replaced(spark, ["+49 30 123456", "+1 (555) 123-4567", "(555) 123-4567", "Κύριος Παπαδόπουλος", *ips])
    assert re.fullmatch(r"\+49 \d{2} \d{6}", got[0]) and got[0] != "+49 30 123456"
    assert got[1].startswith("+1 (") and got[1][3:] == got[2] != "(555) 123-4567"
    assert re.fullmatch(r"Κύριος [Ͱ-Ͽ]+", got[3]) and got[3] != "Κύριος Παπαδόπουλος"
    new = got[4:]
    assert [n.split(".")[0] for n in new[:4]] == ["10", "127", "192", "172"] and new[2].startswith("192.168.") and 16 <= int(new[3].split(".")[1]) <= 31
    assert all(240 <= int(n.split(".")[0]) < 255 for n in new[4:]) and not set(new) & set(ips)


def test_a_retried_batch_counts_once(spark):
    table = lambda rows: spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    rows, folder = [("b", "x y"), ("a", "xy"), ("c", "z"), (None, "z")], common.scratch(spark, "dedup-retry")
    first = sorted(map(tuple, stream_dedup.groups(table(rows), folder, batch="day-1").collect()), key=str)
    assert [(r[0], r[1], r[2], r[3]) for r in first] == sorted([("a", "b", 2, False), ("b", "b", 2, True), ("c", "c", 2, True), (None, "c", 2, False)], key=str)
    assert sorted(map(tuple, stream_dedup.groups(table(rows), folder, batch="day-1").collect()), key=str) == first
    last = stream_dedup.groups(table([("0", "z"), ("aa", "x  y")]), folder, batch="day-2").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in last) == [("0", "0", 3), ("aa", "aa", 3)]
    content = spark.read.parquet(f"{folder}/content")
    assert content.count() == 6
    for wrong in ("a/b", ".."):
        try:
            stream_dedup.groups(table(rows), folder, batch=wrong)
            raise AssertionError("a batch name with a path is refused")
        except ValueError:
            pass


def test_long_and_odd_urls(spark):
    urls = ["https://x.org/" + "a" * n for n in (20_000, 80_000, 300_000)] + ["http://b.com/de/1"] * 3 + ["http://b.com/fr/1", "", "://", "http://x.org/\n\r\t", "http://ÄÖ.org/é", None, None]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, urls[3], None, None)], "page_id long, url string, sign string, gram string")
    began = time.time()
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 1 and {r.verdict for r in got if r.rule == "com/de/"} == {"block"} and time.time() - began < 60
    sign, order = "ab/c" * 5, 3
    grams = [r.gram for r in url_filter.grams(spark.createDataFrame([(sign,)], "sign string"), order).collect()]
    whole = url_filter.START * order + sign + url_filter.END
    assert grams == [whole[i : i + order + 1] for i in range(len(sign) + 1)]


def test_error_rates(spark):
    rows = [(i, f"http://site{i % 40}.com/{'fr' if i % 2 else 'de'}/{'page' if i % 2 else 'artikel'}{i}") for i in range(400)]
    got = url_filter.error_rates(spark.createDataFrame(rows, "page_id long, url string"))
    assert got["allowed"] > 20 and got["blocked"] > 20 and got["lost"] < 0.05 and got["let_in"] < 0.05
    assert url_filter.error_rates(spark.createDataFrame([], "page_id long, url string")) == {"allowed": 0, "blocked": 0, "lost": None, "let_in": None}


def test_components_without_edges_are_one_look(spark):
    sc = spark.sparkContext
    edges = spark.createDataFrame([(3, 3)], "a long, b long")
    sc.setJobGroup("no edges", "")
    try:
        assert components.components(edges).isEmpty()
        assert len(sc.statusTracker().getJobIdsForGroup("no edges")) < 8  # 11 before
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(90, 70), (80, 90), (70, 70)], "a long, b long")
    assert dict(components.components(chain).collect()) == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((70, 80, 90), 70)}


def test_the_join_leaves_no_broadcast(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(jaccard_join, "index", lambda texts, shared, f=jaccard_join.index: sent.append(shared) or f(texts, shared))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "a b c")], "doc_id long, text string")
    got = {tuple(r) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {(1, 56, 1), (2, 57, 1), (3, 1, 3)}
    assert not sent[0]._jbroadcast.isValid()


def test_the_fit_settles_the_driver_after_each_round(spark, monkeypatch):
    done = []
    monkeypatch.setattr(toxicity, "settle", lambda s, f=toxicity.settle: done.append("settle") or f(s))
    monkeypatch.setattr(toxicity, "one_round", lambda *a, f=toxicity.one_round: done.append("round") or f(*a))
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words {i}") for i in range(40)], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"), toxicity.Toxicity(bits=8, steps=20))
    assert model.emb is not None and done == ["round", "settle"] * (len(done) // 2) and done


def test_runs_with_digits_and_latin_letters_are_merged_side_by_side(monkeypatch):
    import numpy as np
    import public_tokenizers

    from lodestone.llm.token_files import WordEncoder

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = WordEncoder(f.read())
    texts = ["L'année, (2024): x9y <b>Été</b> 3×4÷2 naïve;", "", "don't 7\u0301 =\u0338 é\u0301, ÀÉ. 12ab'34"]
    data, edge = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    want, whole, asked = [enc.whole(t) + [1] for t in texts], enc.whole, []
    monkeypatch.setattr(enc, "whole", lambda run: asked.append(run) or whole(run))
    ids, size = enc.encode(data, edge)
    assert ids.tolist() == sum(want, []) and size.tolist() == list(map(len, want))
    assert asked and all(re.search("['×÷\u0301\u0338]", run) for run in asked), asked


def test_the_changes_of_a_pass_come_piece_by_piece(spark, monkeypatch):
    """No collect() of a fit brings the weights' changes, which are of the models' size, to the driver in one piece."""
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "bad worse").otherwise("fine good"), F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    sizes, kind = [], type(docs)
    binary = lambda rows: sum(len(x) for r in rows for x in r if isinstance(x, bytes | bytearray))

    def collect(self, f=kind.collect):
        rows = f(self)
        sizes.append(binary(rows))
        return rows

    monkeypatch.setattr(kind, "collect", collect)
    fitted = toxicity.fit_toxicity(docs, labels, toxicity.Toxicity(bits=12, steps=20, batch=16))
    assert fitted.emb is not None and sizes and max(sizes) == 0
