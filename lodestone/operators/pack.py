"""Fit ranked results into a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TRUNCATED, estimate_tokens, trim_end


def budgeted(results: DataFrame, budget: int) -> DataFrame:
    """query, position, path, snippet, truncated: each query's results in order, as far as its budget goes.

    A fold over each query's (short) list: what a cut snippet leaves of the budget, because its end is trimmed, is there for
    those behind it.
    """
    mark = len(TRUNCATED)
    start = F.struct(F.array().cast("array<struct<position:int,path:string,snippet:string,truncated:boolean>>").alias("out"), F.lit(budget).alias("left"))

    def step(acc, r):
        text, left = r["snippet"], acc["left"]
        cut = F.when(left >= mark, F.concat(trim_end(text.substr(F.lit(1), left - mark)), F.lit(TRUNCATED))).when(left >= mark - 1, F.lit(TRUNCATED.lstrip("\n"))).otherwise("")
        fits = F.length(text) <= left
        new = F.when(fits, text).otherwise(cut)
        row = F.struct(r["position"].alias("position"), r["path"].alias("path"), new.alias("snippet"), (~fits).alias("truncated"))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), (left - F.length(new)).alias("left"))

    lists = results.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col("position").cast("int").alias("position"), "path", "snippet"))).alias("rows"))
    return lists.select("query", F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("r")).select("query", "r.*")


def summary(packed: DataFrame) -> DataFrame:
    """query, results, used_chars, tokens, truncated of budgeted results."""
    used = F.sum(F.length("snippet"))
    return packed.groupBy("query").agg(F.count(F.lit(1)).alias("results"), used.alias("used_chars"), estimate_tokens(used).alias("tokens"), F.count_if("truncated").alias("truncated"))


def cut_to(text: Column, most) -> Column:
    """A text of at most `most` characters: its front and the mark, or as much of the mark as there is room for."""
    mark, most = len(TRUNCATED), F.lit(most) if isinstance(most, int) else most
    bare = F.lit(TRUNCATED.lstrip("\n"))
    return F.when(F.length(text) <= most, text).when(most <= 0, "").when(most < mark, bare.substr(F.lit(1), most)).otherwise(F.concat(trim_end(text.substr(F.lit(1), most - mark)), F.lit(TRUNCATED)))


def related_snippets(paths: DataFrame, chunks: DataFrame, each: int, snippet: int, budget: int) -> DataFrame:
    """query_id, at, path, start_line, end_line, snippet, truncated: the first `each` chunks of each path, in the order of
    paths (query_id, at, path), as far as a query's own budget goes.

    Each chunk is cut to `snippet` characters, then to what is left. A chunk that comes out empty ends its path.
    """
    wanted = F.broadcast(paths.select("path").distinct())  # files near a bounded set of queries: texts are not shuffled
    first = F.row_number().over(Window.partitionBy("path").orderBy("ordinal"))
    heads = chunks.join(wanted, "path", "left_semi").withColumn("n", first).where(F.col("n") <= each)
    rows = paths.join(heads, "path").select("query_id", "at", "n", "path", "start_line", "end_line", cut_to(trim_end(F.col("text")), snippet).alias("snippet"), (F.length(trim_end(F.col("text"))) > snippet).alias("truncated"))
    kind = "array<struct<at:int,path:string,start_line:int,end_line:int,snippet:string,truncated:boolean>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(budget).alias("left"), F.lit(-1).alias("ended"))

    def step(acc, r):
        new = cut_to(r["snippet"], acc["left"])
        go = (acc["left"] > 0) & (acc["ended"] != r["at"])
        row = F.struct(r["at"].alias("at"), r["path"].alias("path"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), new.alias("snippet"), (r["truncated"] | (F.length(r["snippet"]) > acc["left"])).alias("truncated"))
        some = go & (F.length(new) > 0)
        return F.struct(F.when(some, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"), F.when(some, acc["left"] - F.length(new)).otherwise(acc["left"]).alias("left"), F.when(go & (F.length(new) == 0), r["at"]).otherwise(acc["ended"]).alias("ended"))

    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "n", "path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "snippet", "truncated"))).alias("rows"))
    return lists.select("query_id", F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("r")).select("query_id", "r.*")


def context_pack(primary: DataFrame, resolved: DataFrame, related: DataFrame, snippets: DataFrame, most: int) -> DataFrame:
    """query_id, primary_count, related_count, snippet_count, primary_chars, related_chars, tokens, related_tokens, paths.

    `primary` is budgeted() results by query_id; `related` the related files (query_id, at, path); `snippets` what
    related_snippets() gives. Suggested paths are those of results, then of each related file what it imports and what
    imports it, `most` of each, by their first places.
    """
    one = primary.groupBy("query_id").agg(F.count(F.lit(1)).alias("primary_count"), F.sum(F.length("snippet")).alias("primary_chars"))
    two = snippets.groupBy("query_id").agg(F.count(F.lit(1)).alias("snippet_count"), F.sum(F.length("snippet")).alias("related_chars"))
    three = related.groupBy("query_id").agg(F.count(F.lit(1)).alias("related_count"))
    files = related.select("path").distinct()
    at = lambda *by: F.row_number().over(Window.partitionBy("path").orderBy(*by))
    out = resolved.join(files, "path", "left_semi").withColumn("n", at("line", "specifier")).where(F.col("n") <= most).where("resolved_path IS NOT NULL").select("path", F.lit(1).alias("way"), "n", F.col("resolved_path").alias("to"))
    into = resolved.where("resolved_path IS NOT NULL").select(F.col("resolved_path").alias("path"), F.col("path").alias("to"), "line").join(files, "path", "left_semi").withColumn("n", at("to", "line")).where(F.col("n") <= most).select("path", F.lit(2).alias("way"), "n", "to")
    ways = related.join(out.unionByName(into), "path").select("query_id", "to", F.struct(F.lit(1).alias("kind"), F.col("at").cast("int").alias("at"), "way", "n").alias("place"))
    own = primary.select("query_id", F.col("path").alias("to"), F.struct(F.lit(0).alias("kind"), F.col("position").cast("int").alias("at"), F.lit(0).alias("way"), F.lit(0).alias("n")).alias("place"))
    first = own.unionByName(ways).groupBy("query_id", "to").agg(F.min("place").alias("place"))
    paths = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "to"))), lambda x: x["to"]).alias("paths"))
    whole = one.join(two, "query_id", "left").join(three, "query_id", "left").join(paths, "query_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return whole.select("query_id", "primary_count", zero("related_count").alias("related_count"), zero("snippet_count").alias("snippet_count"), zero("primary_chars").alias("primary_chars"), zero("related_chars").alias("related_chars"), estimate_tokens(zero("primary_chars") + zero("related_chars")).alias("tokens"), estimate_tokens(zero("related_chars")).alias("related_tokens"), "paths")
