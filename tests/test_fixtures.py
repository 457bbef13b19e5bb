"""Behaviours on small fixtures: planner, graph, entities, packing, corpora, streams."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import text as T
from latticework.functions import vector as V
from latticework.operators import graph as G
from latticework.operators import kg as K
from latticework.operators import net as N
from latticework.operators import packing as P
from latticework.operators import scoring as S
from latticework.operators import store as ST
from latticework.plans import evaluate as E
from latticework.plans import planner as PL
from latticework.plans import queries as Q
from latticework.sources import corpus as C
from latticework.sources import vector_table as VT

CHAIN = [
    ("acq", "Nimbus acquired Voxel.", [0.2, 0.9798, 0.0, 0.0], ("Nimbus", "acquired", "Voxel")),
    ("founder", "Elena founded Nimbus.", [0.2, 0.0, 0.0, 0.9798], ("Elena", "founded", "Nimbus")),
    ("bio", "Elena studied at Tromso.", [0.5, 0.0, 0.866, 0.0], ("Elena", "studied at", "Tromso")),
    ("distract", "Harvard hosts a founders club.", [0.95, 0.31225, 0.0, 0.0], ("Harvard", "hosts", "Founders Club")),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([c[:3] for c in CHAIN], "id string, text string, vector array<float>")


@pytest.fixture(scope="module")
def kg(spark, docs):
    t = spark.createDataFrame([(c[0], 0, *c[3]) for c in CHAIN], "doc_id string, pos int, s string, p string, o string")
    got = K.build_from_triples(docs, t)
    return K.KnowledgeGraph(*(getattr(got, x).cache() for x in C.TABLES))


@pytest.fixture(scope="module")
def plan(docs, kg):
    return lambda **config: PL.Planner(ST.VectorStore(docs), None, PL.PlannerConfig(**config), kg, K.rule_extractor(5))


def ask(spark, seeds=None, exclude=None, text="Where did the founder study?"):
    names, row = ["qid", "text", "vector"], ["q", text, [1.0, 0.0, 0.0, 0.0]]
    kinds = ["string", "string", "array<double>"]
    for n, v in (("seed_entities", seeds), ("exclude_docs", exclude)):
        if v is not None:
            names.append(n)
            row.append(v)
            kinds.append("array<string>")
    return spark.createDataFrame([tuple(row)], ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))


def test_injected_seeds_steer(spark, plan):
    got = plan().retrieve(ask(spark, ["Elena"]))
    by = {r.node: r for r in got.scored.collect()}
    assert by["bio"].structural > 0 and by["distract"].structural < 1e-9
    assert [r.node for r in got.seeds.collect()] == ["ent:elena"]
    ends = got.paths.collect()
    assert ends and all(r.path[0] == "ent:elena" and r.hops <= 4 for r in ends)


def test_mentions_join_injected_seeds(spark, plan):
    got = plan().retrieve(ask(spark, ["Elena"], text="Did Harvard know?"), explain=False)
    assert [r.node for r in got.seeds.orderBy("pos").collect()] == ["ent:elena", "ent:harvard"]
    again = plan().retrieve(ask(spark, ["Elena", "elena", "Elena"]), explain=False)
    assert again.seeds.count() == 1


def test_excluded_documents_go(spark, plan):
    got = plan().retrieve(ask(spark, ["Elena"], ["distract", "founder"]), explain=False)
    assert [r.node for r in got.sources.orderBy("position").collect()][0] == "bio"
    assert got.scored.count() == 2


def test_seeds_need_a_graph(spark, docs):
    with pytest.raises(ValueError):
        PL.Planner(ST.VectorStore(docs)).retrieve(ask(spark, ["Elena"]))
    with pytest.raises(ValueError):
        PL.Planner(ST.VectorStore(docs)).retrieve(spark.createDataFrame([("q", "text")], "qid string, text string"))
    with pytest.raises(NotImplementedError):
        PL.Planner(object())


def test_exclusion_without_a_graph(spark, docs):
    q = ask(spark, exclude=["distract"]).drop("text")
    got = PL.Planner(ST.VectorStore(docs)).retrieve(q)
    assert "distract" not in {r.node for r in got.scored.collect()}


def test_convergence_ranks_the_distractor_last(spark, plan):
    got = plan(weights=S.Weights(0.0, 0.0, 1.0)).retrieve(ask(spark, ["Elena", "Voxel"]), explain=False)
    assert [r.node for r in got.scored.orderBy("rank").collect()][-1] == "distract"


def masses(d):
    return {(r.qid, r.node): r.mass for r in d.collect()}


def test_walks(spark, kg):
    trans, nodes = G.transitions(kg.edges).cache(), kg.nodes
    seeds = spark.createDataFrame([("a", "ent:elena"), ("a", "ent:elena"), ("b", "ent:voxel"), ("b", "ent:elena"), ("c", "ent:nobody")], "qid string, node string")
    one = masses(G.pagerank(trans, nodes, seeds))
    assert abs(sum(v for (q, _), v in one.items() if q == "a") - 1) < 1e-4
    far = masses(G.pagerank(trans, nodes, seeds, G.WalkConfig(max_iter=50, tol=1e-6), local_edges=0))
    assert one.keys() == far.keys()
    assert max(abs(one[k] - far[k]) for k in one) < 1e-12
    alone = masses(G.pagerank(trans, nodes, seeds.filter("qid = 'b'")))
    assert max(abs(one[k] - alone[k]) for k in alone) < 1e-6
    hub = masses(G.pagerank(G.transitions(kg.edges, 1.0), nodes, seeds.filter("qid = 'a'")))
    assert hub["a", "ent:nimbus"] < one["a", "ent:nimbus"] and abs(sum(hub.values()) - 1) < 1e-4


def test_lost_mass_returns_to_the_seeds(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    nodes, seeds = spark.createDataFrame([("a",), ("b",), ("z",)], "node string"), spark.createDataFrame([("q", "a"), ("q", "z")], "qid string, node string")
    trans = G.transitions(edges)
    leak, back = (G.WalkConfig(max_iter=8, tol=0.0, dangling=x) for x in ("leak", "restart"))
    assert sum(masses(G.pagerank(trans, nodes, seeds, leak)).values()) < 0.99
    for limit in (10, 0):
        assert abs(sum(masses(G.pagerank(trans, nodes, seeds, back, local_edges=limit)).values()) - 1) < 1e-9


def mentions_of(spark, rows):
    d = spark.createDataFrame(rows, "id string, text string, mentions array<struct<text:string,label:string>>")
    # an extractor that finds what the fixture lists
    table = {t: [m["text"] if isinstance(m, dict) else m[0] for m in ms] for _, t, ms in rows}

    def extractor(text):
        out = F.array().cast("array<struct<text:string,label:string>>")
        for t, ms in table.items():
            out = F.when(text == t, F.array(*(F.struct(F.lit(m).alias("text"), F.lit("ORG").alias("label")) for m in ms))).otherwise(out)
        return out

    return d, extractor


def nodes_of(kg):
    return {r.node for r in kg.nodes.filter("kind = 'entity'").collect()}


def aliases_of(kg):
    return {r.alias: r.node for r in kg.aliases.collect()}


def test_linked_mentions_are_one_node(spark):
    d, x = mentions_of(spark, [("d1", "one", [("Alice", "ORG"), ("USA", "ORG")]), ("d2", "two", [("Bob", "ORG"), ("United States", "ORG")])])
    links = spark.createDataFrame([("USA", "united states"), ("United States", "united states"), ("Alice", "alice"), ("Bob", "bob")], "mention string, canonical string")
    kg = K.build(d, x, links)
    assert nodes_of(kg) == {"ent:united states", "ent:alice", "ent:bob"}
    assert {r.doc_id for r in kg.mentions.filter("node = 'ent:united states'").collect()} == {"d1", "d2"}
    assert aliases_of(kg)["usa"] == "ent:united states"
    assert {"ent:usa", "ent:united states"} <= nodes_of(K.build(d, x))


@pytest.mark.parametrize("order", [1, -1])
def test_short_forms(spark, order):
    d, x = mentions_of(spark, [("d1", "t", [("Scott Derrickson", "ORG"), ("Derrickson", "ORG")][::order])])
    kg = K.build(d, x)
    assert nodes_of(kg) == {"ent:scott derrickson"}
    assert aliases_of(kg)["derrickson"] == "ent:scott derrickson" and set(aliases_of(kg).values()) <= nodes_of(kg)


def test_a_short_form_with_a_node_of_its_own_keeps_it(spark):
    d, x = mentions_of(spark, [("d1", "one", [("Apple Inc.", "ORG"), ("Apple", "ORG")]), ("d2", "two", [("Apple", "ORG")])])
    kg = K.build(d, x)
    asked = spark.createDataFrame([("q", 0, "Apple")], "qid string, pos int, mention string")
    assert "ent:apple" in nodes_of(kg) and K.resolve(kg, asked).first().node == "ent:apple"


def test_embedding_links_join_the_first_leader(spark):
    m = spark.createDataFrame([("Colour Works",), ("Color Works",), ("Bakery",)], "mention string")
    letters = lambda c: V.hashed_embedding(F.regexp_replace(c, "(?<=.)", " "))
    got = {r.mention: r.canonical for r in K.embedding_links(m, letters).collect()}
    assert got["Color Works"] == got["Colour Works"] == "colour works" and got["Bakery"] == "bakery"


def test_embedding_links_are_taken_over_the_documents(spark, sf):
    """A brute-force greedy clustering of every name that the documents mention."""
    from latticework.plans import queries as Q

    names = K.extract_mentions(Q.documents(spark, sf), K.rule_extractor()).select("mention", T.canonicalize(F.col("mention")).alias("c")).filter("c <> ''").distinct()
    embed = V.hashed_embedding(F.regexp_replace("c", "(?<=.)", " "))
    vectors = {r.c: np.array(r.v) / max(np.linalg.norm(r.v), 1e-12) for r in names.select("c").distinct().select("c", embed.alias("v")).collect()}
    leaders, head = [], {}
    for c in sorted(vectors, key=lambda c: (-len(c), c)):
        head[c] = next((x for x in leaders if vectors[x] @ vectors[c] >= 0.82), c)
        if head[c] == c:
            leaders.append(c)
    want = sorted((r.mention, head[r.c]) for r in names.collect())
    assert len(want) > 64 and sorted((r.mention, r.canonical) for r in Q.QUERIES["d4_embedding_links"](spark, sf).collect()) == want


def test_model_triples_and_cache(spark):
    d = spark.createDataFrame([("d1", "Alice founded Acme."), ("d2", "Acme is in Boston."), ("d3", "broken"), ("d4", "  ")], "id string, text string")

    def model(prompt):
        if "Alice" in prompt:
            return '```json\n{"triples": [["Alice", "founded", "Acme"], ["x", "", "y"], ["a", "b"]]}\n```'
        if "Boston" in prompt:
            return '[["Acme", "located in", "Boston"]]'
        raise RuntimeError("no answer")

    answers = K.call_model(d, model).cache()
    assert answers.count() == 2
    assert K.call_model(d, model, answers).count() == 0
    kg = K.build_from_triples(d, K.triples(d, answers))
    assert nodes_of(kg) == {"ent:alice", "ent:acme", "ent:boston"}
    e = {(r.src, r.dst): r for r in kg.edges.filter("kind = 'relates'").collect()}
    assert e["ent:acme", "ent:alice"].predicates == ["founded"] and len(e) == 2
    assert C.read_cache(spark, "/nowhere/at/all").count() == 0


def test_scores(spark):
    rows = [("q", "strong", 1.0, 1.0, 1.0), ("q", "weak", 0.0, 1.0, 1.0), ("q", "middle", 0.5, 0.5, 0.5), ("one", "a", 0.7, 0.001, 0.0), ("one", "b", 0.7, 0.001, 0.0)]
    d = spark.createDataFrame(rows, "qid string, node string, relevance double, structural double, coherence double")
    for mode in ("sum", "geom"):
        by = {r.node: r.score for r in S.composite(d, integration=mode).collect()}
        assert by["strong"] > by["middle"] and by["strong"] > by["weak"] and by["a"] == by["b"] and np.isfinite(by["a"])
    with pytest.raises(ValueError):
        S.composite(d, integration="other")
    parts = [d.select("qid", "node", F.col(c).alias("value")).filter(f"node <> '{n}'") for c, n in (("relevance", "weak"), ("structural", "strong"), ("coherence", "a"))]
    assert S.combine(*parts).count() == 5


def test_chunks(spark):
    text = "The first one is here. The second follows it. A third is added. Then the fourth. Five are enough. Six is more. Seven ends it."
    d = spark.createDataFrame([("doc1", text), ("short", "short"), ("none", ""), ("null", None)], "id string, text string")
    got = T.chunk_by_sentences(d, 10, 1).filter("source_id = 'doc1'").collect()
    assert len(got) >= 2 and len({r.id for r in got}) == len(got) and sum(len(r.text) for r in got) >= len(text)
    assert T.chunk_by_chars(d, 100).filter("source_id = 'short'").count() == 1
    assert T.chunk_by_chars(d, 50, 60).filter("source_id in ('none', 'null')").count() == 0
    assert T.chunk_documents(d, "other").count() == T.chunk_by_chars(d).count()


def test_paths(spark):
    edges = spark.createDataFrame([("doc:p1", "ent:alice"), ("doc:p2", "ent:alice"), ("doc:p2", "ent:bob"), ("doc:p3", "ent:bob")], "src string, dst string")
    seeds = spark.createDataFrame([("q", "ent:alice", 0)], "qid string, node string, pos int")
    targets = spark.createDataFrame([("q", "doc:p2"), ("q", "doc:p3")], "qid string, node string")
    ppr = spark.createDataFrame([("q", "doc:p1", 0.3), ("q", "doc:p2", 0.5), ("q", "doc:p3", 0.2)], "qid string, node string, mass double")
    got = G.reasoning_paths(G.shortest_paths(edges, seeds, targets, 4), ppr).collect()
    assert got[0].path == ["ent:alice", "doc:p2"] and got[0].score == 0.25
    assert {tuple(r.path) for r in got} == {("ent:alice", "doc:p2"), ("ent:alice", "doc:p2", "ent:bob", "doc:p3")}


def test_path_between(kg):
    got = G.path_between(kg.edges, kg.nodes, "ent:voxel", "ent:tromso")
    assert got["connected"] and len(got["paths"]) <= 3
    hops = [p["hops"] for p in got["paths"]]
    assert hops == sorted(hops)
    assert all(p["nodes"][0]["node"] == "ent:voxel" and p["nodes"][-1]["node"] == "ent:tromso" for p in got["paths"])
    assert not G.path_between(kg.edges, kg.nodes, "ent:voxel", "ent:harvard")["connected"]
    with pytest.raises(KeyError):
        G.path_between(kg.edges, kg.nodes, "ent:voxel", "ent:nobody")


def all_simple_paths(links, a, b):
    out, todo = [], [[a]]
    while todo:
        p = todo.pop()
        if p[-1] == b:
            out.append(p)
            continue
        todo += [[*p, x] for x in links[p[-1]] if x not in p]
    return sorted(out, key=lambda p: (len(p), p))


def test_routes_are_all_simple_paths_shortest_first(spark):
    rng = np.random.default_rng(4)
    docs = [(f"d{i}", sorted({f"ent:e{k}" for k in rng.integers(0, 7, rng.integers(1, 4))})) for i in range(6)]
    mentions = spark.createDataFrame([(d, e) for d, es in docs for e in es], "doc_id string, node string")
    edges = K.cooccurrence(mentions).select("src", "dst").union(mentions.select(F.concat(F.lit("doc:"), "doc_id"), "node"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    links = {}
    for r in edges.collect():
        links.setdefault(r.src, set()).add(r.dst)
        links.setdefault(r.dst, set()).add(r.src)
    names = sorted(links)
    pairs = [(i, a, b) for i, (a, b) in enumerate([(a, b) for a in names for b in names if a < b][::5])]
    both = spark.createDataFrame(pairs, "qid int, a string, b string")
    trans = G.transitions(edges)
    got = {}
    for path in (N.of_edges(trans, nodes), N.of_mentions(nodes, mentions)):
        got = {}
        for r in N.all_routes(path, both).orderBy("qid", "k").collect():
            got.setdefault(r.qid, []).append(list(r.path))
        assert got == {i: p[:50] for i, a, b in pairs if (p := all_simple_paths(links, a, b))}
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(9)], "src string, dst string")
    ends = chain.select(F.col("src").alias("node")).union(chain.select("dst")).distinct().withColumn("label", F.lit(None).cast("string"))
    assert G.path_between(chain, ends, "n0", "n9")["paths"][0]["hops"] == 9


@pytest.mark.parametrize("gamma", [0.0, 1.0])
def test_walks_on_mentions_equal_those_on_edges(spark, gamma):
    rng = np.random.default_rng(7)
    rows = sorted({(f"d{d}", f"ent:e{e}") for d, e in zip(rng.integers(0, 20, 90).tolist(), rng.integers(0, 12, 90).tolist())})
    mentions = spark.createDataFrame(rows, "doc_id string, node string")
    edges = K.cooccurrence(mentions).select("src", "dst", "weight").union(mentions.select(F.concat(F.lit("doc:"), "doc_id"), "node", F.lit(1).cast("bigint")))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(spark.createDataFrame([("doc:none",)], "node string")).distinct()
    seeds = spark.createDataFrame([("a", "ent:e1"), ("a", "ent:e5"), ("b", "doc:d3"), ("c", "nobody")], "qid string, node string")
    for config in (G.WalkConfig(tol=0.0), G.WalkConfig(alpha=0.6, tol=1e-4, dangling="restart")):
        want = masses(G.pagerank(G.transitions(edges, gamma), nodes, seeds, config))
        got = masses(N.walks(N.of_mentions(nodes, mentions, G.degrees(edges), gamma), seeds, config))
        far = masses(G.pagerank(G.transitions(edges, gamma), nodes, seeds, config, local_edges=0))
        assert want.keys() == got.keys() == far.keys()
        assert max(abs(want[k] - got[k]) for k in want) < 1e-12 and max(abs(want[k] - far[k]) for k in want) < 1e-12
    way = [(r.qid, r.target, tuple(r.path)) for p in (N.of_mentions(nodes, mentions), N.of_edges(G.transitions(edges), nodes)) for r in N.all_paths(p, seeds.withColumn("pos", F.length("node")), None, 3).orderBy("qid", "target").collect()]
    assert way[: len(way) // 2] == way[len(way) // 2 :] and len(way) > 30


def test_packing():
    v = [[1.0, 0.0], [1.0, 0.001], [0.0, 1.0], None]
    assert P.pick([0.9, 0.1, 0.1, 0.1], [10, 10, 10, 10], v, 100, 0.3) == [0, 2, 3]
    assert P.pick([0.9, 0.8, 0.7], [60, 50, 40], None, 100, 0.3) == [0, 2]


def test_louvain():
    two = [(a, b) for s in (0, 4) for a in range(s, s + 4) for b in range(a + 1, s + 4)] + [(3, 4)]
    part = G.louvain(8, two)
    assert part == [0] * 4 + [1] * 4


def test_clusters_come_back_on_topic(spark):
    rng = np.random.default_rng(0)
    rows, centres = [], rng.normal(0, 5, (5, 32))
    for t, c in enumerate(centres):
        for k in range(15):
            x = c + rng.normal(0, 0.6, 32)
            rows.append((f"t{t}_d{k}", f"Doc topic={t} idx={k}", (x / np.linalg.norm(x)).tolist()))
    store = ST.VectorStore(spark.createDataFrame(rows, "id string, text string, vector array<float>"))
    assert store.dim == 32 and store.knn_graph().filter("id = nbr").count() == 0
    q = spark.createDataFrame([(f"q{t}", (c / np.linalg.norm(c)).tolist()) for t, c in enumerate(centres)], "qid string, vector array<double>")
    got = PL.Planner(store, None, PL.PlannerConfig(use_coherence=True, use_community_anchor=True)).retrieve(q, 5).sources.collect()
    assert sum(r.node.startswith(f"t{r.qid[1:]}_") for r in got) > 0.6 * len(got)
    with pytest.raises(KeyError):
        store.get_many(["t0_d0", "nothing"])
    assert [r.id for r in store.get_many(["t1_d0", "t0_d0"]).collect()] == ["t1_d0", "t0_d0"]
    with pytest.raises(ValueError):
        ST.VectorStore(store.docs.limit(0))


def test_approximate_neighbours_find_nine_in_ten(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    x = np.array([r.vector for r in v.orderBy(F.col("id").cast("int")).collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {frozenset((str(a), str(b))) for a, b in zip(*np.nonzero(np.triu(x @ x.T, 1) >= 0.35))}
    got = {frozenset((r.id, r.nbr)) for r in ST.VectorStore(v).approximate_neighbors(0.35).collect()}
    assert len(want & got) >= 0.9 * len(want) and want


def test_ties_in_blocks():
    from latticework.operators.blocks import best_of

    s = np.array([[0.5, 1.0, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2], [-np.inf, 0.3, 0.1, 0.3]])
    assert best_of(s, 2).tolist() == [[1, 0], [0, 1], [1, 3]]
    assert best_of(s, 9)[:2].tolist() == [[1, 0, 2, 3], [0, 1, 2, 3]]
    rng = np.random.default_rng(1)
    s = rng.integers(0, 4, (50, 30)).astype(float)
    assert best_of(s, 7).tolist() == [sorted(range(30), key=lambda j: (-x[j], j))[:7] for x in s.tolist()]


def test_corpora(spark, docs, kg, tmp_path):
    m = C.CorpusManager(spark, f"{tmp_path}/corpora")
    assert m.list() == []
    assert m.build("chain", docs, kg)["documents"] == 4
    store, back = m.load("chain")
    assert sorted(map(tuple, back.edges.drop("predicates").collect())) == sorted(map(tuple, kg.edges.drop("predicates").collect()))
    assert store.docs.count() == 4 and [x["name"] for x in m.list()] == ["chain"]
    assert m.planner("chain") is m.planner("chain") and m.warmup() == {"chain": "ready"}
    with pytest.raises(FileNotFoundError):
        m.load("missing")
    again = C.kg_from_json(C.kg_to_json(kg))
    for t in C.TABLES:
        a, b = getattr(kg, t), getattr(again, t)
        assert a.select(sorted(a.columns)).exceptAll(b.select(sorted(b.columns))).isEmpty() and a.count() == b.count()


def test_vector_table(spark, tmp_path):
    from latticework.sources.vector_table import VectorTable

    spark.dataSource.register(VectorTable)
    d = spark.createDataFrame([(str(i), f"text {i}", [float(i)]) for i in range(50)], "id string, text string, vector array<float>")
    opts = {"path": f"{tmp_path}/v", "collection": "c"}
    d.write.format("vectortable").options(**opts).mode("append").save()
    d.filter("id = '7'").withColumn("text", F.lit("new")).write.format("vectortable").options(**opts).mode("append").save()
    got = {r.id: r.text for r in spark.read.format("vectortable").options(**opts).load().collect()}
    assert len(got) == 50 and got["7"] == "new" and got["8"] == "text 8"
    d.limit(3).write.format("vectortable").options(**opts).mode("overwrite").save()
    assert spark.read.format("vectortable").options(**opts).load().count() == 3
    assert len([f for f in os.listdir(f"{tmp_path}/v/c") if f.endswith(".parquet")]) <= 3  # the old parts are gone


def test_collection(spark, tmp_path):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(f"k{i:03d}", f"text {i}", rng.normal(size=8).tolist()) for i in range(60)], "id string, text string, vector array<float>")
    c = VT.Collection.from_documents(d, f"{tmp_path}/v", "named", buckets=5, distances=True, embed=lambda t: V.hashed_embedding(t, 8))
    store = ST.VectorStore(d)
    q = d.limit(4).select(F.col("id").alias("qid"), "vector")
    rows = lambda x: sorted((r.qid, r.id, round(r.similarity, 5), r["rank"]) for r in x.collect())
    found = c.search(q, 5)
    assert rows(found) == rows(store.search(q, 5)) and found.filter("abs(distance + similarity - 1) > 1e-9").isEmpty()
    assert [r.nbr for r in c.neighbors("k007", 3).orderBy("rank").collect()] == [r.nbr for r in store.neighbors(d.filter("id = 'k007'"), 3).orderBy("rank").collect()]
    c.upsert(spark.createDataFrame([("k007", "seven words here"), ("new", "a new one")], "id string, text string"))
    assert c.get("k007").first().text == "seven words here" and c.get("k008").first().text == "text 8"
    with pytest.raises(KeyError):
        c.get("none")
    assert c.dim == 8 and c.all_ids().count() == 61
    pages = list(c.pages(25))
    assert [len(p) for p in pages] == [25, 25, 11] and sum(pages, []) == sorted(sum(pages, []))
    with pytest.raises(ValueError):
        VT.Collection(spark, f"{tmp_path}/v", "none").upsert(d.drop("vector"))


def test_hashed_embedding_is_that_of_plain_python(spark, sf):
    for r in Q.documents(spark, sf).limit(50).withColumn("v", V.hashed_embedding(F.col("text"))).collect():
        want = np.zeros(32)
        for w in re.split(r"[ \t\n\x0b\f\r]+", r.text.lower()):
            want[zlib.crc32(w.encode()) % 32] += bool(w)
        assert np.allclose(r.v, want / max(np.linalg.norm(want), 1e-300))


def test_chunks_without_a_title_fail(spark):
    chunks = spark.createDataFrame([(1, 1, "A", None), (1, 1, "B", None), (1, 2, None, "f")], "qid int, pos int, name string, file string")
    titles, files = spark.createDataFrame([("A",), ("B",)], "title string"), spark.createDataFrame([("f", "F")], "filename string, title string")
    assert E.attribute_chunks(chunks, titles, files, ["name"], ["file"]).first().titles == ["A", "B", "F"]
    with pytest.raises(Exception, match="cannot attribute"):
        E.attribute_chunks(chunks, titles.limit(1), files, ["name"], ["file"]).collect()


def test_two_planners_agree(spark, sf):
    """Arrays in tasks against joins, over the smallest tables."""
    q = Q._by_id(spark, sf).limit(6).cache()  # noqa: SLF001
    near, far = (Q._planner(spark, sf, local_edges=n).retrieve(q, 4, explain=True, everything=True) for n in (1 << 30, 0))  # noqa: SLF001
    a, b = ({(r.qid, r.node): (r.score, r.coherence, r.structural) for r in p.scored.collect()} for p in (near, far))
    assert a.keys() == b.keys() and len(a) > 500
    assert max(abs(x - y) for k in a for x, y in zip(a[k], b[k])) < 1e-6
    assert sorted(map(tuple, near.paths.select("qid", "target", "hops").collect())) == sorted(map(tuple, far.paths.select("qid", "target", "hops").collect()))
    assert near.paths.filter("qid is null or size(path) <> hops + 1").isEmpty()


def test_path_tool(spark, kg, docs):
    p = PL.Planner(ST.VectorStore(docs), kg=kg)
    pairs = spark.createDataFrame([(1, "Voxel", "tromso"), (2, "Voxel", "Nobody at all"), (3, "Voxel", "Harvard")], "qid int, entity_a string, entity_b string")
    got = {}
    for r in p.path_between(pairs).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r)
    assert got[1][0].connected and got[1][0].path[0] == "ent:voxel" and got[1][0].path[-1] == "ent:tromso" and got[1][0].labels[0] == "Voxel" and len(got[1]) <= 3
    assert "Nobody at all" in got[2][0].error and got[2][0].connected is None
    assert got[3][0].error is None and got[3][0].connected is False and got[3][0].path is None


def test_stream_ingest(spark, tmp_path):
    from latticework.streaming.ingest import ingest, merged_edges

    source = f"{tmp_path}/in"
    rows = [("1", "Bravehearts met Silverstone and Greenfields"), ("2", "Silverstone and Greenfields again"), ("3", "Bravehearts only")]
    for r in rows:
        spark.createDataFrame([r], "id string, text string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema("id string, text string").parquet(source), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    want = K.build(spark.read.parquet(source)).edges.filter("kind = 'co_occurs'").select("src", "dst", "weight").collect()
    got = merged_edges(spark, f"{tmp_path}/out").select("src", "dst", "weight").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    # a newer version of a document without names takes its edges away
    again = spark.createDataFrame([("1", "nobody at all"), ("1", "Another Version")], "id string, text string").withColumn("version", F.length("text"))
    again.coalesce(1).write.parquet(f"{tmp_path}/in2")
    ingest(spark.readStream.schema("id string, text string, version int").parquet(f"{tmp_path}/in2"), f"{tmp_path}/out2", f"{tmp_path}/check2").awaitTermination()
    assert [r.node for r in spark.read.parquet(f"{tmp_path}/out2").collect()] == ["ent:another version"]


def test_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(k % 4, k) for k in range(40)], "batch_id int, x int")
    at, ledger = f"{tmp_path}/out", f"{tmp_path}/ledger"
    assert C.ingest_resumable(rows.filter("batch_id < 2"), at, ledger) == 2
    assert C.ingest_resumable(rows, at, ledger) == 2 and C.ingest_resumable(rows, at, ledger) == 0
    assert sorted(r.x for r in spark.read.parquet(at).collect()) == list(range(40))
    # a batch that was written but not noted is not doubled
    spark.createDataFrame([(7, 100), (7, 101)], "batch_id int, x int").write.partitionBy("batch_id").mode("append").parquet(at)
    assert C.ingest_resumable(rows.union(spark.createDataFrame([(7, 100), (7, 101)], rows.schema)), at, ledger) == 1
    assert spark.read.parquet(at).filter("batch_id = 7").count() == 2


def test_model_embedder_loads_once_in_a_worker(spark, tmp_path):
    log = f"{tmp_path}/loads"

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    embed = V.model_embedder(load, batch=3)
    d = spark.createDataFrame([(str(i), "x" * i if i % 5 else None) for i in range(1, 41)], "id string, text string").repartition(8)
    got = {r.id: r.v for r in d.withColumn("v", embed("text")).collect()}
    assert got["10"] is None and np.allclose(got["3"], np.array([3, 1]) / np.sqrt(10))
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))


def test_hops_leave_out_what_was_seen_and_follow_the_bridge(spark, plan, docs, kg):
    p = plan(weights=S.Weights(0.0, 1.0, 0.0), use_convergence=False)
    q = spark.createDataFrame([("q", "Who leads Voxel?", [1.0, 0.0, 0.0, 0.0])], "qid string, text string, vector array<double>")
    first, second = p.iterate([(q, []), (q, ["Elena"])], top_k=1)
    a, b = (x.sources.first() for x in (first, second))
    assert a.node == "acq" and b.node not in (a.node, "distract")
    assert second.scored.filter("node = 'acq'").isEmpty() and [r.node for r in second.seeds.orderBy("pos").collect()][0] == "ent:elena"


def test_arms_of_the_ablation(spark, sf):
    q, p = Q._by_id(spark, sf).limit(4).cache(), Q._planner(spark, sf)  # noqa: SLF001
    got = p.ablation(q, 5)
    for arm, config in (("baseline", {"use_convergence": False}), ("both", {"hub_discount": 1.0})):
        want = Q._planner(spark, sf, **config).retrieve(q, 5, explain=False).scored.filter("rank < 5").select("qid", "node", "rank")  # noqa: SLF001
        assert sorted(map(tuple, got.filter(F.col("arm") == arm).select("qid", "node", "rank").collect())) == sorted(map(tuple, want.collect()))
    assert got.groupBy("arm").count().count() == 4
