"""Scores of candidates, per query: components(qid, node, relevance, structural, coherence)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
PARTS = ("relevance", "structural", "coherence")


@dataclass(frozen=True)
class Weights:
    relevance: float = 3.0
    structural: float = 1.0
    coherence: float = 1.0


def minmax(c: Column, *by: str) -> Column:
    """To 0..1 within each group; 0.5 for all where they hardly differ; null stays."""
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(c.isNotNull(), F.when(high - low < EPS, F.lit(0.5)).otherwise((c - low) / F.when(high - low < EPS, F.lit(1.0)).otherwise(high - low)))


def relevance(cosines: DataFrame) -> DataFrame:
    """(qid, node, cosine) with relevance, its share of the query's range."""
    return cosines.withColumn("relevance", minmax(F.col("cosine"), "qid"))


def coherence(edges: DataFrame, nodes: DataFrame, anchor: DataFrame) -> DataFrame:
    """Share of each node's neighbours in anchor(node); 0 for one without neighbours. edges: src, dst; nodes: node."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    near = both.join(anchor.select(F.col("node").alias("dst"), F.lit(1.0).alias("hit")), "dst", "left")
    share = near.groupBy(F.col("src").alias("node")).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("coherence"))
    return nodes.select("node").join(share, "node", "left").select("node", F.coalesce("coherence", F.lit(0.0)).alias("coherence"))


def composite(components: DataFrame, weights: Weights = Weights(), integration: str = "sum") -> DataFrame:
    """Adds `score`: the weighted mean ("sum") or geometric mean ("geom") of the components brought to 0..1; a missing one counts 0."""
    if integration not in ("sum", "geom"):
        raise ValueError(f"unknown integration mode: {integration!r}")
    total = weights.relevance + weights.structural + weights.coherence
    d = components.select("*", *(F.coalesce(minmax(F.col(c), "qid"), F.lit(0.0)).alias(f"_{c}") for c in PARTS))
    if integration == "sum":
        score = sum(getattr(weights, c) * F.col(f"_{c}") for c in PARTS) / total
    else:
        score = F.exp(sum(getattr(weights, c) * F.log(EPS + F.col(f"_{c}")) for c in PARTS) / total)
    return d.withColumn("score", score).drop(*(f"_{c}" for c in PARTS))


def combine(r: DataFrame, s: DataFrame, c: DataFrame) -> DataFrame:
    """Components from three tables (qid, node, value), on the union of their nodes."""
    named = [x.select("qid", "node", F.col("value").alias(n)) for x, n in zip((r, s, c), PARTS)]
    return named[0].join(named[1], ["qid", "node"], "full_outer").join(named[2], ["qid", "node"], "full_outer")


def convergence(per_seed: DataFrame) -> DataFrame:
    """per_seed(qid, grp, node, mass), a group per seed: (qid, node, value), the geometric mean over the seeds."""
    return per_seed.groupBy("qid", "node").agg(F.exp(F.avg(F.log(F.lit(1e-12) + F.col("mass")))).alias("value"))


def ranked(scored: DataFrame, decimals: int | None = None) -> DataFrame:
    """Adds `rank` from 0 by falling score, rounded where decimals are given, ties by node."""
    by = F.round("score", decimals) if decimals else F.col("score")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(by.desc(), "node")) - 1)
