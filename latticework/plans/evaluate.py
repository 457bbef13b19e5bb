"""Evaluation of retrieval: results(qid, ids ARRAY) against questions(qid, gold ARRAY)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(ids: Column, gold: Column, k: int) -> Column:
    """Share of gold among the first k; null where gold is empty."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(ids, 1, k), gold)) / F.size(gold))


def retrievable_gold(questions: DataFrame, pool: DataFrame) -> DataFrame:
    """Gold that the pool(title) has, in order."""
    g = questions.select("qid", F.posexplode("gold").alias("pos", "title")).join(pool.select("title"), "title", "left_semi")
    kept = g.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("gold"))
    return questions.drop("gold").join(kept, "qid", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))


def mean_recall(results: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (2, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """results(strategy, qid, ids): mean recall for each strategy, k and group; questions without gold are skipped."""
    d = results.join(questions, "qid").filter(F.size("gold") > 0)
    each = d.select("strategy", *by, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), recall(F.col("ids"), F.col("gold"), k).alias("recall")) for k in ks))).alias("x"))
    return each.groupBy("strategy", *by, F.col("x.k").alias("k")).agg(F.avg("x.recall").alias("recall"), F.count("*").alias("n"))


def per_hop(results: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Mean recall by number of hops, and overall (n_hops null), in one pass."""
    d = results.join(questions, "qid").filter(F.size("gold") > 0).withColumn("r", recall(F.col("ids"), F.col("gold"), k))
    return d.rollup("strategy", "n_hops").agg(F.avg("r").alias("recall"), F.count("*").alias("n")).filter("strategy is not null")


def delta_points(means: DataFrame, base: str, other: str) -> DataFrame:
    """mean_recall rows: by how many points `other` is above `base`, for each k."""
    a, b = (means.filter(F.col("strategy") == s).select("k", F.col("recall").alias(n)) for s, n in ((base, "a"), (other, "b")))
    return a.join(b, "k").select("k", (100 * (F.col("b") - F.col("a"))).alias("points"))


def latency(times: DataFrame) -> DataFrame:
    """times(ms): mean, median and 95th percentile."""
    return times.agg(F.avg("ms").alias("mean"), F.percentile("ms", F.lit(0.5)).alias("median"), F.percentile("ms", F.lit(0.95)).alias("p95"))


def attribute_chunks(chunks: DataFrame, titles: DataFrame, files: DataFrame, id_fields: list[str], path_fields: list[str]) -> DataFrame:
    """chunks(qid, pos, fields...): the titles of each answer in order, each once; ids are tried before paths, in the order given.

    Every chunk stands alone, also where several have one position: these come
    in the order of their fields. A chunk without a title makes the query fail.
    """
    tries = [(c, titles.select(F.col("title").alias("key"), "title").distinct()) for c in id_fields]
    tries += [(c, files.select(F.col("filename").alias("key"), "title").groupBy("key").agg(F.min("title").alias("title"))) for c in path_fields]
    d = chunks
    for n, (c, table) in enumerate(tries):
        d = d.join(table.select(F.col("key").alias(f"_k{n}"), F.col("title").alias(f"_t{n}")), F.col(c) == F.col(f"_k{n}"), "left").drop(f"_k{n}")
    lost = F.raise_error(F.concat(F.lit("cannot attribute a chunk of query "), F.col("qid").cast("string")))
    title = F.coalesce(*(F.col(f"_t{n}") for n in range(len(tries))), lost)
    key = F.struct("pos", *(F.col(c) for c in (*id_fields, *path_fields)), title.alias("title"))
    return d.groupBy("qid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["title"])).alias("titles"))


def identical_passes(passes: DataFrame, top: int = 10) -> DataFrame:
    """passes(pass, qid, ids): questions that all passes have, and for how many the first ids are the same."""
    n = passes.select("pass").distinct().count()
    per = passes.groupBy("qid").agg(F.countDistinct("pass").alias("passes"), F.countDistinct(F.slice("ids", 1, top)).alias("lists")).filter(F.col("passes") == n)
    return per.agg(F.count("*").alias("questions"), F.count(F.when(F.col("lists") == 1, 1)).alias("identical"))


def sample_questions(questions: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n questions in a random order that the seed fixes."""
    return questions.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("qid").cast("string")).cast("binary")), "qid").limit(n)


def pool_first(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(title, text, pos): one text for each title, the first."""
    w = Window.partitionBy("title").orderBy("pos")
    return paragraphs.withColumn("k", F.row_number().over(w)).filter("k = 1").select("title", "text")
