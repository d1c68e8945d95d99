"""URL filter: rules first, then the ratio of two character language models, with Spark's operators only.

Accepted and rejected URLs (those that a rule allows or blocks) each train a variable-order Markov model:
counts of the characters behind contexts of up to `order` characters, smoothed by interpolation with the
next shorter context (Witten-Bell), down to the uniform distribution. A URL's score is the difference of
its log-likelihoods under the two models, divided by its number of characters; it is allowed if the score
reaches a threshold, calibrated on rule-labelled URLs of a fold that the models did not see.

Characters are folded to an alphabet of 42 signs, so that a model has at most 43**(order+1) rows at any size
of the input; that bound is what allows the broadcast of the scored grams.

Defined results: a null or malformed URL (no "://") has empty host and path and no rule, and is scored like
any other text; rows repeat as they come; without labels of both classes every URL is allowed; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Fixed values: (verdict, host, path), of which the longest that fits decides.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The signs that stay themselves; digits become 0, other characters *.
SIGNS = "abcdefghijklmnopqrstuvwxyz0/.-_?=&%:#+~"
START, END, OTHER = "^", "$", "*"
ALPHABET = len(SIGNS) + 3


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def folded(url: Column) -> Column:
    """The URL in the models' alphabet, without its scheme's case and with digits as 0."""
    low = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.regexp_replace(low, r"[^a-z0/.\-_?=&%:#+~]", OTHER)


def grams(rows: DataFrame, order: int) -> DataFrame:
    """One row for each character of sign: gram, the character behind its `order` predecessors."""
    padded = F.concat(F.lit(START * order), F.col("sign"), F.lit(END))
    windows = F.regexp_extract_all(padded, F.lit(f"(?=(.{{{order + 1}}}))"), F.lit(1))  # one walk over the URL, however long it is
    return rows.select(*[c for c in rows.columns if c != "sign"], F.explode(windows).alias("gram"))


def train(labelled: DataFrame, order: int) -> DataFrame:
    """gram, ok (count under allow), bad (count under block) of full-length grams."""
    return grams(labelled, order).groupBy("gram").agg(F.count_if(F.col("label") == "allow").alias("ok"), F.count_if(F.col("label") == "block").alias("bad"))


def scored_grams(wanted: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """gram, ratio: log P(last character | rest) under the accepted less under the rejected model.

    For each length of context: n (its count), t (kinds of characters behind it) and c (the gram's count) give
    p = (c + t * p_shorter) / (n + t), with p = 1 / ALPHABET at the bottom.
    """
    out = wanted.select("gram").withColumns({"p_ok": F.lit(1.0 / ALPHABET), "p_bad": F.lit(1.0 / ALPHABET)})
    for k in range(order + 1):
        tail = counts.withColumn("tail", F.substring("gram", order + 1 - k, k + 1)).groupBy("tail").agg(F.sum("ok").alias("c_ok"), F.sum("bad").alias("c_bad"))
        context = tail.withColumn("context", F.substring("tail", 1, k)).groupBy("context").agg(*[e for m in ("ok", "bad") for e in (F.sum(f"c_{m}").alias(f"n_{m}"), F.count_if(F.col(f"c_{m}") > 0).alias(f"t_{m}"))])
        out = out.withColumns({"tail": F.substring("gram", order + 1 - k, k + 1), "context": F.substring("gram", order + 1 - k, k)})
        out = out.join(tail, "tail", "left").join(context, "context", "left").drop("tail", "context")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        for m in ("ok", "bad"):
            n, t = zero(f"n_{m}"), zero(f"t_{m}")
            out = out.withColumn(f"p_{m}", F.when(n > 0, (zero(f"c_{m}") + t * F.col(f"p_{m}")) / (n + t)).otherwise(F.col(f"p_{m}")))
        out = out.drop("c_ok", "c_bad", "n_ok", "n_bad", "t_ok", "t_bad")
    return out.select("gram", (F.log("p_ok") - F.log("p_bad")).alias("ratio"))


def judge(pages: DataFrame, rules=RULES, order: int = 3, folds: int = 5, bins: int = 2000) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of page_id, url."""
    scored, least = _scored(pages, rules, order, folds, bins)
    verdict = F.coalesce("known", F.when(F.col("score") >= F.lit(least), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def error_rates(pages: DataFrame, rules=RULES, order: int = 3, folds: int = 5, bins: int = 2000) -> dict:
    """How well the method alone judges URLs that a rule labels: fold 1 is kept from models and threshold, and judged by both.

    allowed, blocked: how many URLs of the fold each verdict of a rule has; lost, let_in: the shares of them judged otherwise.
    """
    scored, least = _scored(pages, rules, order, folds, bins, 1)
    ok = F.col("score") >= F.lit(least)
    r = scored.where("known IS NOT NULL AND fold = 1").agg(F.count_if(F.col("known") == "allow").alias("a"), F.count_if((F.col("known") == "allow") & ~ok).alias("al"), F.count_if(F.col("known") == "block").alias("b"), F.count_if((F.col("known") == "block") & ok).alias("bl")).first()
    return {"allowed": r["a"], "blocked": r["b"], "lost": r["al"] / r["a"] if r["a"] else None, "let_in": r["bl"] / r["b"] if r["b"] else None}


def _scored(pages: DataFrame, rules, order: int, folds: int, bins: int, apart: int = 0) -> tuple[DataFrame, float]:
    """The rows with their rule, fold and score, and the threshold; models learn from folds beyond `apart`, 0 sets the threshold."""
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    rule, known = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "known": known, "sign": folded(F.col("url"))})
    rows = stored(rows.withColumn("fold", F.pmod(F.crc32(F.coalesce("url", F.lit(""))), F.lit(folds))).drop("url"), "url-rows")
    seen = rows.where("known IS NOT NULL").select("sign", F.col("known").alias("label"), "fold")
    counts = stored(train(seen.where(F.col("fold") > apart).select("sign", "label"), order), "url-model")
    # Equal URLs are scored once; each URL's grams stay in its task up to the sum, and carry its digest, not the URL.
    own = F.sha2("sign", 256).alias("text")
    texts = rows.select("sign", own).distinct()
    wanted = grams(texts.select("sign"), order).select("gram").distinct()
    model = stored(scored_grams(wanted, counts, order), "url-grams")  # at most 43**(order+1) rows
    each = grams(texts, order).join(F.broadcast(model), "gram")
    score = stored(each.groupBy("text").agg((F.sum(F.round("ratio", 9).cast("decimal(20,9)")) / F.count(F.lit(1))).cast("double").alias("score")), "url-scores")
    scored = rows.withColumn("text", own).join(score, "text")
    least = threshold(scored.where("known IS NOT NULL AND fold = 0").select("score", F.col("known").alias("label")), bins)
    both = counts.agg(F.sum("ok").alias("ok"), F.sum("bad").alias("bad")).first()
    if not (both["ok"] and both["bad"]):
        least = float("-inf")
    discard(counts, model)
    return scored, least


def threshold(held: DataFrame, bins: int = 2000, least: float = -4.0, most: float = 4.0) -> float:
    """The score that separates held-out URLs with the least sum of error rates, the one nearest 0 of several.

    Scores are counted in `bins` equal steps, which bounds what comes to the driver.
    """
    step = (most - least) / bins
    at = F.floor((F.least(F.greatest("score", F.lit(least)), F.lit(most - step / 2)) - least) / step).cast("int")
    got = held.groupBy(at.alias("at")).agg(F.count_if(F.col("label") == "allow").alias("ok"), F.count_if(F.col("label") == "block").alias("bad")).collect()
    n_ok, n_bad = sum(r["ok"] for r in got), sum(r["bad"] for r in got)
    if not n_ok or not n_bad:
        return 0.0
    ok, bad = [0] * bins, [0] * bins
    for r in got:
        ok[r["at"]], bad[r["at"]] = r["ok"], r["bad"]
    best, lost_ok, kept_bad = (2.0, 0.0, 0.0), 0, n_bad
    for i in range(bins + 1):  # the threshold is the lower edge of bin i
        edge = least + i * step
        best = min(best, (round(lost_ok / n_ok + kept_bad / n_bad, 12), abs(edge), edge))
        if i < bins:
            lost_ok, kept_bad = lost_ok + ok[i], kept_bad - bad[i]
    return best[2]
