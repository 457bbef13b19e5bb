"""Graphs as arrays: what tasks make of the incidence, against plain Python."""

from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import kg as K
from latticework.operators import net as N


def plan_of(d):
    return d._jdf.queryExecution().toString()  # noqa: SLF001


def size_of(d):
    """Bytes that Spark takes a table to have."""
    return int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # noqa: SLF001


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    rare = {(f"{d}", f"ent:e{e}") for d, e in zip(rng.integers(0, 60, 150).tolist(), rng.integers(0, 40, 150).tolist())}
    return sorted(rare | {(f"{d}", "ent:hub") for d in range(60)} | {("61", "ent:alone")})


@pytest.fixture(scope="module")
def incidence(spark, rows):
    mentions = spark.createDataFrame(rows, "doc_id string, node string")
    nodes = mentions.select("node").union(mentions.select(F.concat(F.lit("doc:"), "doc_id"))).union(spark.createDataFrame([("doc:none",)], "node string"))
    return N.incidence(nodes, mentions)


@pytest.fixture(scope="module")
def shared(rows):
    per = defaultdict(list)
    for d, e in rows:
        per[d].append(e)
    return Counter(p for x in per.values() for p in permutations(x, 2))


@pytest.mark.parametrize("pairs", [1, 1 << 20])
def test_cooccurrences_of_rare_and_of_frequent_names(spark, rows, incidence, shared, pairs, monkeypatch):
    monkeypatch.setattr(N, "_PAIRS", pairs)
    net = N.Net(incidence)
    for upper in (False, True):
        got = [(net.names[int(a)].as_py(), net.names[int(b)].as_py(), int(n)) for x in net.together(0, len(net.ents), upper) for a, b, n in zip(*x)]
        assert got == sorted((a, b, n) for (a, b), n in shared.items() if a < b or not upper)


def test_edges_neighbours_and_transitions(spark, rows, incidence, shared):
    docs = defaultdict(list)
    for d, e in rows:
        docs[e].append(f"doc:{d}")
    assert {(r.src, r.dst): r.weight for r in N.cooccurrences(incidence, spark).collect()} == {k: n for k, n in shared.items() if k[0] < k[1]}
    want = set()
    for e, own in docs.items():
        best = sorted((-n, b) for (a, b), n in shared.items() if a == e)[:3]
        want |= {(e, "entity", b, float(-n), k) for k, (n, b) in enumerate(best, 1)} | {(e, "document", b, 1.0, k) for k, b in enumerate(sorted(own)[:3], 1)}
    assert {tuple(r) for r in N.neighbors(incidence, spark, 3).collect()} == want
    degree = Counter(a for a, _ in shared) + Counter(e for _, e in rows) + Counter(f"doc:{d}" for d, _ in rows)
    assert {r.node: r.degree for r in N.degrees(incidence, spark).collect()} == degree
    cut = {e: np.log(np.e + degree[e]) ** -1.0 for e in docs}
    w = {(a, b): n * cut[a] * cut[b] for (a, b), n in shared.items()} | {k: cut[e] for d, e in rows for k in ((f"doc:{d}", e), (e, f"doc:{d}"))}
    total = Counter()
    for (a, _), x in w.items():
        total[a] += x
    got = {(r.src, r.dst): r.p for r in N.transitions(N.weighted(incidence, spark, 1.0), spark).collect()}
    assert got.keys() == w.keys() and all(abs(got[k] - w[k] / total[k[0]]) < 1e-12 for k in w)


def test_pairs_are_not_shuffled(spark, rows):
    """The pairs of entities in documents, which are many more than the mentions, stay in the tasks that make them."""
    docs = spark.createDataFrame([(d, "Anna Berg met Carl Dorn. And Emil Falk.") for d in "abc"], "id string, text string")
    kg = K.build(docs, eager=True)
    for d in (kg.edges.filter("kind = 'co_occurs'"), N.neighbors(kg.incidence, spark), N.transitions(N.weighted(kg.incidence, spark), spark)):
        assert d.count() and "Exchange" not in plan_of(d)


def test_what_tasks_make_is_not_taken_to_be_small(spark, incidence):
    """Else joins broadcast the masses of all nodes for all groups, through the driver."""
    seeds = spark.createDataFrame([("a", "ent:hub", 0), ("b", "ent:e3", 0)], "qid string, node string, pos int")
    path = N.weighted(incidence, spark)
    for d in (N.walks(path, seeds, N.WalkConfig()), N.all_paths(path, seeds, None, 3), N.cooccurrences(incidence, spark)):
        assert size_of(d) > 1 << 40


def old_louvain(n, edges, rounds=10, seed=0):
    """With a dict for each node."""
    weights = [{} for _ in range(n)]
    for a, b in edges:
        weights[a][b] = weights[a].get(b, 0) + 1.0
        weights[b][a] = weights[b].get(a, 0) + 1.0
    member = list(range(n))
    while True:
        k = [sum(x.values()) for x in weights]
        total = sum(k) or 1.0
        own, mass, moved = list(range(len(weights))), list(k), False
        for _ in range(rounds):
            again = False
            for v in np.random.default_rng(seed).permutation(len(weights)).tolist():
                near = {}
                for u, w in weights[v].items():
                    if u != v:
                        near[own[u]] = near.get(own[u], 0) + w
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
        names = {c: i for i, c in enumerate(dict.fromkeys(own))}
        member = [names[own[m]] for m in member]
        bigger = [{} for _ in names]
        for v, row in enumerate(weights):
            for u, w in row.items():
                a, b = names[own[v]], names[own[u]]
                bigger[a][b] = bigger[a].get(b, 0) + w
        weights = bigger
    first = {c: i for i, c in enumerate(dict.fromkeys(member))}
    return [first[m] for m in member]


def test_louvain_on_arrays():
    from latticework.operators.graph import louvain

    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (30, 60), (200, 500), (200, 2000)):
        edges = [tuple(x) for x in rng.integers(0, n, (m, 2)).tolist()]
        assert louvain(n, edges) == old_louvain(n, edges)


def test_searches_hold_strips(tmp_path, monkeypatch):
    """Nearest rows, ties by name, in a few MB however large the blocks are."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.parquet as pq

    from latticework.operators import blocks as B

    rng = np.random.default_rng(2)
    v = rng.standard_normal((9000, 24))
    v[5000:5300] = v[:300]
    names = sorted(str(i) for i in range(len(v)))
    for i in range(3):
        pq.write_table(pa.table({"k": names[i * 3000 : i * 3000 + 3000], "v": v[i * 3000 : i * 3000 + 3000].tolist()}), tmp_path / f"part-{i}.parquet")
    todo = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([3])], ["a", "low", "high"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(B._search(str(tmp_path), str(tmp_path), 5, True)([todo])))  # noqa: SLF001
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u[3000:6000] @ u.T, B.DECIMALS)
    s[np.arange(3000), np.arange(3000, 6000)] = -np.inf
    want = [(names[3000 + i], names[j]) for i, x in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :5].tolist()) for j in x]
    assert list(zip(got["id"].to_pylist(), got["nbr"].to_pylist())) == want
