"""Graph operators over edges(src, dst[, weight]) that are stored once per undirected pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators import net
from latticework.operators.net import WalkConfig
from latticework.session import stash, unsized

#: Directed transitions, and nodes, up to which a graph is kept as arrays: tasks map 12 bytes for each transition and hold some 60 for each node.
LOCAL_EDGES = 20_000_000
#: Mentions that may be kept for each of these: tasks map 8 bytes for each.
MENTIONS = 20


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions, (src, dst, weight); weight 1 where there is none; a self-loop counts in both."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("weight"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def transitions(edges: DataFrame, hub_discount: float = 0.0) -> DataFrame:
    """(src, dst, p): weights, discounted at entity ends by log(e + degree)^-hub_discount, of sum 1 by src."""
    e = edges.select("src", "dst", *(["weight"] if "weight" in edges.columns else []))
    if hub_discount:
        d = degrees(edges)
        w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
        e = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
        cut = lambda n, g: F.when(F.col(n).startswith("ent:"), F.pow(F.log(F.lit(np.e) + F.col(g)), F.lit(hub_discount))).otherwise(F.lit(1.0))
        e = e.select("src", "dst", (w / cut("src", "ds") / cut("dst", "dd")).alias("weight"))
    s = symmetric(e)
    merged = s.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return merged.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("p"))


def pagerank(trans: DataFrame, nodes: DataFrame, seeds: DataFrame, config: WalkConfig | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Personalised PageRank of many seed groups at once: (qid, node, mass), rows of mass 0 left out.

    trans(src, dst, p), nodes(node), seeds(qid, node): repeated seeds count
    once, unknown ones not at all, and a group without a known seed restarts
    anywhere. Up to local_edges transitions and nodes the graph is kept as
    arrays that tasks map, and groups run in parallel; beyond, walks are joins
    and groupings keyed by (qid, node). Both give the same masses: a group
    stops after the first step whose L1 change is below tol, or after max_iter.
    """
    config = config or WalkConfig()
    seeds = seeds.select("qid", "node").distinct()
    trans, nodes = stash(trans.select("src", "dst", "p"), "pagerank-trans"), stash(nodes.select("node"), "pagerank-nodes")
    if trans.count() <= local_edges and nodes.count() <= local_edges:
        return net.walks(net.of_edges(trans, nodes), seeds, config)
    return _distributed(trans, nodes, seeds, config)


def _restart(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, node, r): where each group restarts."""
    known = seeds.join(nodes.select("node"), "node", "left_semi")
    some = known.withColumn("r", 1.0 / F.count("*").over(Window.partitionBy("qid")))
    lost = seeds.select("qid").distinct().join(known, "qid", "left_anti")
    n = nodes.agg(F.count("*").alias("n"))
    anywhere = lost.crossJoin(nodes.select("node")).crossJoin(F.broadcast(n)).select("node", "qid", (1.0 / F.col("n")).alias("r"))  # n is one row
    return some.select("qid", "node", "r").unionByName(anywhere.select("qid", "node", "r"))


def _distributed(trans: DataFrame, nodes: DataFrame, seeds: DataFrame, config: WalkConfig) -> DataFrame:
    restart = stash(_restart(nodes, seeds), "restart")
    trans = stash(trans, "trans")
    ends = trans.select("src").distinct()
    going = restart.select("qid", "node", F.col("r").alias("mass"))
    done: list[DataFrame] = []
    none = F.lit(0.0)
    for _ in range(config.max_iter):
        moved = going.join(trans, going["node"] == trans["src"]).select("qid", F.col("dst").alias("node"), (F.col("mass") * F.col("p") * (1 - config.alpha)).alias("m"), none.alias("old"))
        parts = moved.unionByName(restart.join(going.select("qid").distinct(), "qid", "left_semi").select("qid", "node", (F.col("r") * config.alpha).alias("m"), none.alias("old")))
        parts = parts.unionByName(going.select("qid", "node", none.alias("m"), F.col("mass").alias("old")))
        if config.dangling == "restart":
            lost = going.join(ends, going["node"] == ends["src"], "left_anti").groupBy("qid").agg(F.sum("mass").alias("lost"))
            parts = parts.unionByName(restart.join(lost, "qid").select("qid", "node", (F.col("r") * F.col("lost") * (1 - config.alpha)).alias("m"), none.alias("old")))
        new = stash(parts.groupBy("qid", "node").agg(F.sum("m").alias("mass"), F.sum("old").alias("old")), "walk")
        change = stash(new.groupBy("qid").agg(F.sum(F.abs(F.col("mass") - F.col("old"))).alias("change")), "walk-change")
        ended = change.filter(F.col("change") < config.tol).select("qid")
        going = new.filter("mass <> 0").select("qid", "node", "mass")
        if not ended.isEmpty():
            done.append(going.join(ended, "qid", "left_semi"))
            going = going.join(ended, "qid", "left_anti")
            if change.filter(F.col("change") >= config.tol).isEmpty():
                break
    for x in done:
        going = going.unionByName(x)
    return going


def induced_subgraph(knn: DataFrame, seeds: DataFrame, hops: int = 2, cap: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Nodes (qid, node, hop) within `hops` of seeds(qid, node) over knn(id, nbr), and the edges (qid, src < dst) among them.

    Beyond the cap the nodes of fewest hops, then of the smallest names, stay.
    """
    visited = seeds.select("qid", "node", F.lit(0).alias("hop")).distinct()
    frontier = visited
    for hop in range(1, hops + 1):
        step = frontier.join(knn, frontier["node"] == knn["id"]).select("qid", F.col("nbr").alias("node")).distinct()
        frontier = step.join(visited, ["qid", "node"], "left_anti").select("qid", "node", F.lit(hop).alias("hop"))
        visited = visited.unionByName(frontier)
    w = Window.partitionBy("qid").orderBy("hop", "node")
    nodes = visited.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= cap).drop("k")
    e = nodes.join(knn, nodes["node"] == knn["id"]).select("qid", F.col("node").alias("a"), F.col("nbr").alias("b"))
    e = e.join(nodes.select("qid", F.col("node").alias("b")), ["qid", "b"], "left_semi")
    return nodes, e.select("qid", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def communities(edges: DataFrame, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(qid, node, community) of subgraphs edges(qid, src, dst), by moving nodes between communities for the greatest modularity (Louvain).

    Without qid all edges are one subgraph. Each is of bounded size, such as
    induced_subgraph gives, and is one task's; communities are numbered by their
    first node.
    """
    own = "qid" in edges.columns
    d = edges.select(*(["qid"] if own else [F.lit(0).alias("qid")]), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    kind = d.schema["qid"].dataType.simpleString()

    if not own:
        return _whole(d, rounds, seed)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([f["src"], f["dst"]]), return_inverse=True)
        part = louvain(len(names), np.stack([at[: len(f)], at[len(f) :]], axis=1), rounds, seed)
        return pd.DataFrame({"qid": f["qid"].iloc[0], "node": names, "community": part})

    return d.groupBy("qid").applyInPandas(run, f"qid {kind}, node string, community int")


def _whole(edges: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(node, community) of one graph, which a task maps as arrays."""
    spark = edges.sparkSession
    both = stash(edges.select("src", "dst").union(edges.select("dst", "src")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("p")), "both-ways")
    path = net.of_edges(both, both.select(F.col("src").alias("node")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            g = net.Net(path)
            ptr = np.zeros(g.n + 1, np.int64)
            ptr[g.by_dst.rows + 1] = g.by_dst.sizes
            part = _louvain(np.cumsum(ptr), np.asarray(g.by_dst.of), np.asarray(g.by_dst.p), rounds, seed).astype(np.int32)
            for i in range(0, g.n, 1 << 16):
                x = part[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([g.names.slice(i, len(x)).cast(pa.string()), pa.array(x)], ["node", "community"])

    return unsized(spark.range(0, 1, 1, 1).mapInArrow(run, "node string, community int"))


def louvain(n: int, edges: list[tuple[int, int]] | np.ndarray, rounds: int = 10, seed: int = 0) -> list[int]:
    e = np.asarray(edges, np.int64).reshape(-1, 2)
    return _louvain(*_rows(n, np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), np.ones(2 * len(e))), rounds, seed).tolist()


def _rows(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of directed pairs by their first end: where each node's start, the other ends, sums."""
    key, at = np.unique(a * np.int64(n) + b, return_inverse=True)
    count = np.bincount(key // max(n, 1), minlength=n)
    return np.append(0, np.cumsum(count)), key % max(n, 1), np.bincount(at, w, len(key))


def _louvain(ptr: np.ndarray, of: np.ndarray, w: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Of a symmetric graph: what is linked to node v is of[ptr[v] : ptr[v + 1]], with weights w. They are whole numbers, so sums don't depend on their order."""
    member = np.arange(len(ptr) - 1)
    while True:
        n = len(ptr) - 1
        src = np.repeat(np.arange(n), np.diff(ptr))
        k = np.bincount(src, w, n).tolist()
        total = sum(k) or 1.0
        own, mass, moved = list(range(n)), list(k), False
        starts, order = ptr.tolist(), np.random.default_rng(seed).permutation(n).tolist()
        for _ in range(rounds):
            again = False
            for v in order:
                near: dict[int, float] = {}
                i, j = starts[v], starts[v + 1]
                for u, x in zip(of[i:j].tolist(), w[i:j].tolist()):
                    if u != v:
                        near[own[u]] = near.get(own[u], 0) + x
                mass[own[v]] -= k[v]
                gain = lambda c: near.get(c, 0) - mass[c] * k[v] / total  # noqa: B023, E731
                best = min(near, key=lambda c: (-gain(c), c), default=own[v])
                if gain(best) > gain(own[v]) + 1e-12:
                    own[v], again, moved = best, True, True
                mass[own[v]] += k[v]
            if not again:
                break
        if not moved:
            break
        part = _by_first(np.array(own))
        member = part[member]
        ptr, of, w = _rows(int(part.max()) + 1, part[src], part[of], w)
    return _by_first(member)


def _by_first(own: np.ndarray) -> np.ndarray:
    """Communities numbered by their first node."""
    _, first, at = np.unique(own, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return number[at]


def shortest_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame, max_hops: int = 3) -> DataFrame:
    """Breadth first from seeds(qid, node, pos) to targets(qid, node): (qid, target, path, hops).

    Every node keeps its first discoverer: at the first step the seed of the
    smallest position, later the smallest node. Stops when all targets are found.
    """
    trans = symmetric(edges).select("src", "dst").distinct().withColumn("p", F.lit(1.0))
    nodes = trans.select(F.col("src").alias("node")).union(seeds.select("node")).distinct()
    return net.all_paths(net.of_edges(trans, nodes), seeds, targets, max_hops)


def reasoning_paths(paths: DataFrame, ppr: DataFrame, max_paths: int = 5) -> DataFrame:
    """paths of shortest_paths, ppr(qid, node, mass): (qid, target, path, edges, score), the best of each query; score = mass / (1 + hops)."""
    d = paths.filter("hops >= 1").join(ppr.select("qid", F.col("node").alias("target"), "mass"), ["qid", "target"], "left")
    d = d.withColumn("score", F.coalesce("mass", F.lit(0.0)) / (1 + F.col("hops")))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "hops", "target")
    pairs = F.zip_with(F.slice("path", F.lit(1), F.col("hops")), F.slice("path", F.lit(2), F.col("hops")), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return d.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= max_paths).select("qid", "target", "path", "hops", pairs.alias("edges"), "score")


def neighbors_of(edges: DataFrame, nodes: DataFrame, asked: DataFrame, limit: int = 20) -> DataFrame:
    """asked(qid, node): entities by weight and documents by name that each node is linked to, (qid, kind, neighbor, label, weight, rank), `limit` of each kind."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    e = edges.select("src", "dst", w.alias("weight"))
    both = e.unionByName(e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = asked.join(both, asked["node"] == both["src"]).select("qid", F.col("dst").alias("neighbor"), "weight")
    near = near.join(nodes.select(F.col("node").alias("neighbor"), "kind", "label"), "neighbor")
    k = F.row_number().over(Window.partitionBy("qid", "kind").orderBy(F.desc("weight"), "neighbor"))
    return near.withColumn("rank", k).filter(F.col("rank") <= limit).select("qid", "kind", "neighbor", "label", "weight", "rank")


def distinct_routes(paths: DataFrame, k_paths: int = 3) -> DataFrame:
    """paths(qid, path, hops, k) of net.all_routes: those kept, `rank` from 1. One whose intermediates include all of a kept one's is a detour, and dropped."""
    most = max(1, min(k_paths, 10))
    inner = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"])

    def keep(kept: Column, path: Column) -> Column:
        detour = F.exists(kept, lambda p: (F.size(inner(p)) > 0) & (F.size(F.array_except(inner(p), inner(path))) == 0))
        return F.when(detour | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(path)))

    kept = paths.groupBy("qid").agg(in_order.alias("all")).select("qid", F.posexplode(F.aggregate("all", F.array().cast("array<array<string>>"), keep)).alias("rank", "path"))
    documents = F.size(F.filter("path", lambda n: n.startswith("doc:")))
    return kept.select("qid", (F.col("rank") + 1).alias("rank"), "path", (F.size("path") - 1).alias("hops"), documents.alias("via_documents"))


def path_between(edges: DataFrame, nodes: DataFrame, a: str, b: str, k_paths: int = 3) -> dict:
    """Distinct routes of any length between two nodes, shortest first, from the first 50 simple paths; KeyError for an unknown node."""
    spark = edges.sparkSession
    known = {r.node for r in nodes.filter(F.col("node").isin(a, b)).select("node").collect()}
    for x in (a, b):
        if x not in known:
            raise KeyError(x)
    trans = symmetric(edges).select("src", "dst").distinct().withColumn("p", F.lit(1.0))
    pair = spark.createDataFrame([(0, a, b)], "qid int, a string, b string")
    kept = distinct_routes(net.all_routes(net.of_edges(trans, nodes), pair), k_paths).orderBy("rank").collect()  # 10 at most
    labels = {r.node: r.label for r in nodes.filter(F.col("node").isin(sorted({x for p in kept for x in p.path}))).collect()} if kept else {}
    show = lambda n: {"node": n, "label": n[4:] if n.startswith("doc:") else labels.get(n) or n}
    return {"connected": bool(kept), "paths": [{"nodes": [show(n) for n in p.path], "hops": p.hops, "via_documents": p.via_documents} for p in kept]}


def graph_stats(nodes: DataFrame, edges: DataFrame | None, top: int = 10, degree: DataFrame | None = None) -> DataFrame:
    """(name, value, rank): documents, entities, edges, and the degrees of the entities with the most.

    degree(node, degree): how many neighbours each node has, instead of edges without loops or repeats.
    """
    n = edges.agg(F.count("*").alias("edges")) if degree is None else degree.agg(F.coalesce(F.expr("sum(degree) div 2"), F.lit(0)).alias("edges"))
    counts = nodes.agg(F.count(F.when(F.col("kind") == "document", 1)).alias("documents"), F.count(F.when(F.col("kind") == "entity", 1)).alias("entities")).crossJoin(n)
    stats = counts.select(F.explode(F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).alias("value"), F.lit(0).alias("rank")) for x in ("documents", "entities", "edges")))).alias("s")).select("s.*")
    best = (degrees(edges) if degree is None else degree).filter(F.col("node").startswith("ent:")).orderBy(F.desc("degree"), "node").limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "node")))  # top rows only
    return stats.unionByName(ranked.select(F.col("node").alias("name"), F.col("degree").alias("value"), "rank"))


def entity_subgraph(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src").startswith("ent:") & F.col("dst").startswith("ent:"))
