"""Queries over the driver's tables, one or more for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
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
from latticework.session import scratch_path, stash
from latticework.sources import corpus as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")


def _numbered(s: SparkSession, d: str, rows: DataFrame, number: str) -> DataFrame:
    """Every row with a vector: that whose number is the row's modulo their count."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    n = e.agg(F.count("*").alias("n_vectors"))
    at = rows.crossJoin(F.broadcast(n)).withColumn("vec_id", F.pmod(F.col(number), F.col("n_vectors"))).drop("n_vectors")  # one row on the broadcast side
    return at.join(e, "vec_id").drop("vec_id", number)


def embedded(s: SparkSession, d: str) -> DataFrame:
    return _numbered(s, d, documents(s, d).withColumn("number", F.col("id").cast("bigint")), "number")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")


def items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")


# SQL that several oracles begin with

CANON = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
UNITS = "u as (select vec_id::varchar as id, embedding::double[] as v, label, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings)"
PAIRS = "p as (select a.id, b.id as nbr, list_dot_product(a.v, b.v) / (a.n * b.n) as sim from u a join u b on a.id <> b.id)"
KNN = "k as (select id, nbr, row_number() over (partition by id order by sim desc, nbr) as rank, sim from p qualify rank <= 10)"
MENTIONS = f"""m as (select doc_id::varchar as doc_id, unnest(x) as mention, generate_subscripts(x, 1) - 1 as pos
  from (select doc_id, regexp_extract_all(text, '\\p{{Lu}}\\p{{L}}{{1,}}(?: \\p{{Lu}}\\p{{L}}{{1,}})*') as x from documents)),
mc as (select distinct doc_id, mention, {CANON.format('mention')} as c from m)"""
COLLAPSE = (
    MENTIONS
    + """,
up as (select a.doc_id, a.c, arg_max(b.c, {'n': length(b.c), 'c': b.c}) as longer from mc a join mc b on a.doc_id = b.doc_id and a.c <> b.c and contains(' ' || b.c || ' ', ' ' || a.c || ' ') group by all),
kept as (select mc.doc_id, mc.c, mention, coalesce(longer, mc.c) as k from mc left join up on mc.doc_id = up.doc_id and mc.c = up.c),
ment as (select distinct doc_id, 'ent:' || k as node from kept),
disp as (select distinct c, d from (select c, mention as d from kept union all select k, mention from kept)),
lab as (select c, arg_max(d, {'n': length(d), 'd': d}) as label from disp group by c),
ents as (select c as canonical, 'ent:' || c as node, label, ('ent:' || c) in (select node from ment) as in_graph from lab),
co as (select a.node as src, b.node as dst, count(*) as weight from ment a join ment b on a.doc_id = b.doc_id and a.node < b.node group by all),
edges as (select 'doc:' || doc_id as src, node as dst, 1::bigint as weight, 'mentions' as kind from ment union all select src, dst, weight, 'co_occurs' from co),
nodes as (select 'doc:' || doc_id as node, 'document' as kind from documents union all select node, 'entity' from ents where in_graph),
sym as (select src, dst, weight::double as w from edges union all select dst, src, weight::double from edges),
trans as (select src, dst, w / sum(w) over (partition by src) as p from sym),
alias as (select alias, node from (select canonical as alias, 0 as pass, canonical, '' as d, node from ents where in_graph
  union all select """
    + CANON.format("d")
    + """, 1, canonical, d, node from disp join ents on canonical = c where in_graph) where alias <> '' qualify row_number() over (partition by alias order by pass, canonical, d) = 1)"""
)
ASKED = f"""qm as (select item_id::varchar as qid, unnest(x) as mention, generate_subscripts(x, 1) - 1 as pos
  from (select item_id, regexp_extract_all(text, '\\p{{Lu}}\\p{{L}}{{1,}}(?: \\p{{Lu}}\\p{{L}}{{1,}})*') as x from benchmark)),
qc as (select qid, pos, mention, {CANON.format('mention')} as c from qm),
qh as (select qid, pos, mention, qc.c, coalesce(alias.node, ents.node) as hit from qc left join alias on alias.alias = qc.c left join ents on ents.canonical = qc.c),
qs as (select x.c, arg_min(node, {{'n': -length(label), 'x': node}}) as node from (select distinct c from qh where hit is null) x join ents on contains(canonical, x.c) or contains(x.c, canonical) group by x.c),
res as (select qid, pos, mention, coalesce(hit, qs.node) as node from qh left join qs on qs.c = qh.c),
seeds as (select qid, node, min(pos) as pos from res where node in (select node from nodes) group by all)"""


def ppr_sql(trans: str = "trans", seeds: str = "seeds", name: str = "pr", steps: int = 50, dangling: bool = False) -> str:
    """Power iteration over transitions, unrolled, where a group stops once its change is below 1e-6: CTE <name>(qid, node, mass)."""
    back = ", l as (select src from {t} group by 1)".format(t=trans) if dangling else ""
    move = "select {p}.qid, t.dst as node, 0.85::double * mass * t.p as m from {p} join " + trans + " t on t.src = {p}.node"
    lost = " union all select r.qid, r.node, 0.85::double * r * x from {r} r join (select qid, sum(mass) as x from {p} where node not in (select src from l) group by qid) using (qid)" if dangling else ""
    return _iterate(name, seeds, steps, back, lambda p, r: [(None, move.format(p=p) + lost.format(p=p, r=r))])


def walk_sql(seeds: str = "seeds", name: str = "pr", documents: bool = True) -> str:
    """The same on the graph of `ment`, by its incidence of documents and entities, which holds all co-occurrences."""
    if documents:
        own = "nd as (select d, count(*) as s from inc group by d), ne as (select e, count(*) as k, sum(s) as s from inc join nd using (d) group by e)"
    else:
        own = "nd as (select d, count(*) as s from inc group by d), ne as (select e, count(*) as k, sum(s - 1) as s from inc join nd using (d) group by e)"
    head = f", inc as (select 'doc:' || doc_id as d, node as e from ment), {own}"

    def step(p: str, r: str) -> list:
        through = f"select qid, d, mass / ne.s as t, mass / ne.s as z from {p} join ne on ne.e = {p}.node join inc on inc.e = ne.e where ne.s > 0"
        if documents:
            through += f" union all select qid, d, mass / nd.s, 0 from {p} join nd on nd.d = {p}.node"
        at = f"{p}t"
        out = f"select qid, e as node, 0.85::double * t as m from {at} join inc using (d) union all select qid, e, -0.85::double * k * mass / s from {p} join ne on ne.e = {p}.node where ne.s > 0"
        if documents:
            out += f" union all select qid, d, 0.85::double * z from {at}"
        else:
            out += f" union all select r.qid, r.node, 0.85::double * r * x from {r} r join (select qid, sum(mass) as x from {p} join ne on ne.e = {p}.node where ne.s = 0 group by qid) using (qid)"
        return [(at, f"select qid, d, sum(t) as t, sum(z) as z from ({through}) group by all"), (None, out)]

    return _iterate(name, seeds, 50, head, step)


def _iterate(name: str, seeds: str, steps: int, head: str, step) -> str:
    r = f"{name}r"
    out = [f"{r} as (select qid, node, 1.0::double / count(*) over (partition by qid) as r from {seeds}){head}", f"{name}0 as (select qid, node, r as mass from {r})"]
    for k in range(steps):
        p, q = f"{name}{k}", f"{name}{k + 1}"
        *before, (_, moved) = step(p, r)
        out += [f"{at} as materialized ({sql})" for at, sql in before]
        out.append(
            f"{q}n as materialized (select qid, node, sum(m) as mass, sum(old) as old from (select qid, node, m, 0.0::double as old from ({moved}) union all select qid, node, 0.15::double * r, 0 from {r} where qid in (select qid from {p}) union all select qid, node, 0, mass from {p}) group by all)"
        )
        out.append(f"{q}c as materialized (select qid, sum(abs(mass - old)) as change from {q}n group by qid)")
        out.append(f"{q} as materialized (select qid, node, mass from {q}n where qid in (select qid from {q}c where change >= 1e-6))")
    ended = " union all ".join(f"select qid, node, mass from {name}{k + 1}n where qid in (select qid from {name}{k + 1}c where change < 1e-6)" for k in range(steps))
    out.append(f"{name} as materialized (select qid, node, mass from ({ended} union all select qid, node, mass from {name}{steps}) where mass <> 0)")
    return ",\n".join(out)


# A: stores, corpora, loaders


@query(f"with {UNITS} select id, len(v) as dim, round(n, 6) as norm, round(list_dot_product(v, v) / (n * n), 6) as unit_norm from u")
def a1_store_units(s, d):
    v = vectors(s, d)
    u = ST.VectorStore(v).units
    return v.join(u, "id").select("id", F.size("vector").cast("bigint").alias("dim"), F.round(V.norm(V.doubles(F.col("vector"))), 6).alias("norm"), F.round(V.norm(F.col("u")), 6).alias("unit_norm"))


@query("with x as (select doc_id::varchar as id, list_transform(range(97, 123), lambda c: (length(text) - length(replace(text, chr(c::int), '')))::double) as v from documents) select id, len(v)::int as dim, round(case when list_dot_product(v, v) > 0 then 1 else 0 end::double, 6) as norm, round(v[5] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 5) as e from x")
def a2_from_documents(s, d):
    letters = lambda t: F.array(*(F.length(t) - F.length(F.replace(t, F.lit(chr(c)))) for c in range(97, 123)))
    store = ST.VectorStore.from_documents(documents(s, d), letters)
    return store.units.select("id", F.size("u").alias("dim"), F.round(V.norm(F.col("u")), 6).alias("norm"), F.round(F.col("u")[4], 5).alias("e"))


@query("select vec_id::varchar as id, len(embedding)::int as dim from embeddings")
def a3_vector_table(s, d):
    from latticework.sources.vector_table import VectorTable

    s.dataSource.register(VectorTable)
    at = scratch_path(s, "vectortable")
    rows = vectors(s, d).select("id", F.lit(None).cast("string").alias("text"), "vector")
    rows.filter("id % 2 = 0").withColumn("text", F.lit("old")).write.format("vectortable").option("path", at).mode("append").save()
    rows.write.format("vectortable").option("path", at).mode("append").save()
    return s.read.format("vectortable").option("path", at).load().filter("text is null").select("id", F.size("vector").alias("dim"))


@query("with new as (select event_id, user_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1) select c_custkey as id, coalesce(event_type, c_mktsegment) as tag from customer left join new on user_id = c_custkey union all select user_id, event_type from new where user_id not in (select c_custkey from customer)")
def a5_upsert(s, d):
    old = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tag"), F.lit(0).cast("bigint").alias("seq"))
    new = table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("tag"), F.col("event_id").alias("seq"))
    return ST.upsert(old, new, "id", "seq").select("id", "tag")


@query(f"with {COLLAPSE} select (select count(*) from documents) as documents, (select count(*) from ents where in_graph) as entities, (select count(*) from edges) as edges, 64 as dim")
def a9_corpus_build(s, d):
    docs = embedded(s, d)
    kg = K.build(documents(s, d), eager=True)
    m = C.CorpusManager(s, scratch_path(s, "corpora")).build("c", docs, kg)
    return s.createDataFrame([(m["documents"], m["entities"], m["edges"], m["dim"])], "documents long, entities long, edges long, dim int")


@query("select doc_id::varchar as id, length(text) as n, 64 as dim from documents")
def a10_corpus_load(s, d):
    m = C.CorpusManager(s, scratch_path(s, "corpora"))
    m.build("c", embedded(s, d), K.build(documents(s, d), eager=True))
    store, _ = m.load("c")
    return store.docs.select("id", F.length("text").alias("n"), F.size("vector").alias("dim"))


@query(f"with {COLLAPSE} select 'edges' as part, count(*) as n from edges union all select 'nodes', count(*) from nodes union all select 'entities', count(*) from ents union all select 'aliases', count(*) from alias union all select 'mentions', count(*) from ment")
def a14_kg_json_round_trip(s, d):
    kg = C.kg_from_json(stash(C.kg_to_json(K.build(documents(s, d), eager=True)), "kg-json", "part"))
    parts = [getattr(kg, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("part"), "n") for t in C.TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select sha256(text) as key, count(*) as n from documents where text not in (select text from documents where doc_id % 3 = 0) group by text")
def a15_triple_cache(s, d):
    docs = documents(s, d).withColumn("key", T.content_key(F.col("text")))
    cache = docs.filter("cast(id as bigint) % 3 = 0").select("key").distinct()
    return docs.join(cache, "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


@query("select split_part(text, ' ', 1) as title, arg_min(length(text), doc_id) as n from documents group by 1")
def a16_pool_first_title(s, d):
    docs = table(s, d, "documents").select(F.split("text", " ")[0].alias("title"), "text", F.col("doc_id").alias("pos"))
    return E.pool_first(docs).select("title", F.length("text").alias("n"))


@query(r"with p as (select p_name as title, p_name || ' ' || p_type as text, p_partkey from part qualify row_number() over (partition by p_name order by p_partkey) = 1), x as (select *, left(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), 120) as stem from p), k as (select *, row_number() over (partition by stem order by title) as k from x) select title, stem || case when k > 1 then '__' || k else '' end || '.md' as filename, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::int as n_words, '# ' || title || chr(10) || chr(10) || text || chr(10) as body from k")
def a17_manifest(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_partkey").alias("pos"))
    return C.manifest(E.pool_first(p))


@query("select o_orderpriority as batch_id, count(*) as n from orders where o_orderpriority not in (select distinct o_orderpriority from orders where o_orderkey % 7919 = 1) group by 1")
def a18_resumable_ingest(s, d):
    """A first run ingests the batches of some orders; the second one what its ledger lacks."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("batch_id"))
    at, ledger = scratch_path(s, "ingested"), scratch_path(s, "ledger")
    some = o.filter("o_orderkey % 7919 = 1").select("batch_id").distinct()
    C.ingest_resumable(o.join(some, "batch_id", "left_semi"), at, ledger)
    C.ingest_resumable(o, at, ledger)
    late = s.read.parquet(at).join(some, "batch_id", "left_anti")
    return late.groupBy("batch_id").agg(F.count("*").alias("n"))


@query("select c_nationkey::bigint as qid, 'p1' as pass, count(*) as n from customer group by 1 union all select c_nationkey, 'p2', count(*) from customer group by 1")
def a19_query_dump(s, d):
    at = scratch_path(s, "dump")
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("qid")).agg(F.count("*").alias("n"))
    for p in ("p1", "p2"):
        C.dump_pass(c, at, p)
    return s.read.schema("qid long, n long, pass string").json(at)


@query("with x as (select l_orderkey as qid, l_linenumber::bigint as id, 1 / (1 + exp(-(l_discount * 10 - l_tax * 10))) as score from lineitem) select qid, id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 9) desc, id)::int as rank from x qualify rank <= 3")
def a20_rerank(s, d):
    x = table(s, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").cast("bigint").alias("id"), (F.col("l_discount") * 10 - F.col("l_tax") * 10).alias("logit"))
    return ST.rerank(x.withColumn("logit", F.round("logit", 9)), 3).select("qid", "id", F.round("score", 6).alias("score"), "rank")


# B: text

CHARS = f"""d as (select doc_id::varchar as source_id, text, length(text) as n from documents where length(text) > 0),
w as (select *, unnest(case when n <= 800 then [0::bigint] else range(0, n, 700) end) as i from d),
c as (select source_id, {STRIP.format('substring(text, i::int + 1, 800)')} as text, i::int as char_start, least(i + 800, n)::int as char_end, n from w),
b1 as (select source_id, (row_number() over (partition by source_id order by char_start) - 1)::int as chunk_idx, text, char_start, char_end from c where n <= 800 or text <> '')"""
SENTS = f"""sp as (select doc_id::varchar as id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9"''])', '\\1' || chr(31) || '\\2', 'g'), chr(31)) as x from documents),
se as (select id, list_filter(list_transform(x, lambda t: {STRIP.format('t')}), lambda t: t <> '') as x from sp)"""
PACKED = f"""with recursive {SENTS},
si as (select id, unnest(x) as t, generate_subscripts(x, 1) - 1 as k, len(x) as n from se),
ps as (select id, k, n, t, sum(length(t) + 1) over (partition by id order by k) as upto from si),
en as (select a.id, a.k as i, a.n, greatest(a.k + count(b.k), a.k + 1) as e from ps a left join ps b on a.id = b.id and b.k >= a.k and b.upto - a.upto + length(a.t) + 1 <= 800 group by a.id, a.k, a.n),
ch as (select id, 0 as chunk_idx, i, e, n from en where i = 0 union all select ch.id, chunk_idx + 1, en.i, en.e, en.n from ch join en on en.id = ch.id and en.i = greatest(ch.e - 1, ch.i + 1))"""


@query(f"with {CHARS} select source_id || '#chunk' || chunk_idx as id, * from b1")
def b1_chunk_by_chars(s, d):
    return T.chunk_by_chars(documents(s, d))


@query(f"with {SENTS} select id, unnest(x) as sentence, (generate_subscripts(x, 1) - 1)::int as pos from se")
def b2_sentences(s, d):
    return documents(s, d).select("id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(PACKED + " select id || '#chunk' || chunk_idx as id, id as source_id, chunk_idx::int as chunk_idx, i::int as sent_start, e::int as sent_end, array_to_string(x[i + 1 : e], ' ') as text from ch join se using (id)")
def b3_chunk_by_sentences(s, d):
    return T.chunk_by_sentences(documents(s, d))


@query(PACKED + f", {CHARS} select id as source_id, 'sentences' as strategy, count(*) as n from ch group by 1 union all select source_id, 'chars', count(*) from b1 group by 1")
def b4_chunk_documents(s, d):
    out = [T.chunk_documents(documents(s, d), k).groupBy("source_id").agg(F.count("*").alias("n")).withColumn("strategy", F.lit(k)) for k in ("sentences", "chars")]
    return out[0].unionByName(out[1])


@query(f"with {CHARS} select source_id || '#chunk' || chunk_idx as id, source_id as m_source, chunk_idx::varchar as m_idx, lang as m_lang from b1 join documents on doc_id::varchar = source_id")
def b5_chunk_metadata(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source_id"), F.lit("theirs"), F.lit("chunk_idx"), F.lit("x")).alias("metadata"))
    m = T.chunk_metadata(T.chunk_by_chars(docs), docs)
    return m.select("id", F.col("metadata")["source_id"].alias("m_source"), F.col("metadata")["chunk_idx"].alias("m_idx"), F.col("metadata")["lang"].alias("m_lang"))


@query("select doc_id::varchar as id, greatest(1, length(text) // 4)::int as tokens from documents")
def b6_estimate_tokens(s, d):
    return documents(s, d).select("id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"select doc_id::varchar as id, {CANON.format('text')} as canonical from documents")
def b7_canonicalize(s, d):
    return documents(s, d).select("id", T.canonicalize(F.col("text")).alias("canonical"))


@query("select sha256(text) as key, count(*) as n, min(doc_id) as first from documents group by text")
def b8_content_key(s, d):
    return table(s, d, "documents").groupBy(T.content_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("select count(*) as n, count(distinct doc_id) as ids, true as positive from documents")
def b9_stable_id(s, d):
    return documents(s, d).select("id", T.stable_id(F.col("id")).alias("k")).agg(F.count("*").alias("n"), F.countDistinct("k").alias("ids"), (F.min("k") >= 0).alias("positive"))


@query("select p_partkey as id, 0 as pos, trim(p_name) as s, 'is a' as p, p_type as o from part union all select p_partkey, 1, p_name, 'made by', p_brand from part")
def b10_parse_triples(s, d):
    p = table(s, d, "part")
    rows = F.to_json(F.struct(F.array(F.array(F.concat(F.lit(" "), "p_name"), F.lit("is a"), "p_type"), F.array("p_name", F.lit("made by"), "p_brand"), F.array("p_name", F.lit(" "), "p_brand"), F.array("p_name", F.lit("short"))).alias("triples")))
    raw = F.concat(F.lit("Here:\n```json\n"), rows, F.lit("\n```\nDone."))
    t = p.select(F.col("p_partkey").alias("id"), F.posexplode(T.parse_triples(raw)).alias("pos", "t"))
    return t.select("id", "pos", "t.s", "t.p", "t.o")


@query("select doc_id::varchar as id, 'Facts of: ' || text || ' as JSON {}' as prompt from documents")
def b11_fill_prompt(s, d):
    return documents(s, d).select("id", T.fill_prompt("Facts of: {passage} as JSON {}", F.col("text")).alias("prompt"))


@query(f"select doc_id::varchar as id, 'doc:' || doc_id as node, 'ent:' || {CANON.format('source')} as entity, doc_id::varchar as back from documents")
def b12_nodes(s, d):
    x = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), T.doc_node(F.col("doc_id")).alias("node"), T.entity_node(T.canonicalize(F.col("source"))).alias("entity"))
    return x.withColumn("back", T.node_key(F.col("node")))


@query("select doc_id::varchar as id, substring(text, 1, 280) as snippet from documents")
def b13_snippet(s, d):
    return documents(s, d).select("id", T.snippet(F.col("text")).alias("snippet"))


@query("select c_custkey as id, round(c_acctbal / 7.0::double, 4) as a, round(c_acctbal / 13.0::double, 6) as b from customer")
def b14_rounding(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") / 7, 4).alias("a"), F.round(F.col("c_acctbal") / 13, 6).alias("b"))


@query("select p_partkey as id, contains(' ' || p_type || ' ', ' ' || split_part(p_type, ' ', 1) || ' ') as first_word, contains(' ' || p_type || ' ', ' ' || substring(p_type, 2, 4) || ' ') as inner_part, contains(p_type, substring(p_type, 2, 4)) as raw_part from part")
def b15_containment(s, d):
    t, piece = F.col("p_type"), F.substring("p_type", 2, 4)
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.token_contained(F.split(t, " ")[0], t).alias("first_word"), T.token_contained(piece, t).alias("inner_part"), F.contains(t, piece).alias("raw_part"))


@query("select doc_id::varchar as id, source || chr(10) || chr(10) || text as body from documents")
def b16_title_body(s, d):
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), T.title_body(F.col("source"), F.col("text")).alias("body"))


@query("select doc_id, quality = 1 as a, toxic = 1 as b from labels")
def b17_tolerant_bool(s, d):
    words = F.when(F.col("quality") == 1, "True").otherwise("False")
    return table(s, d, "labels").select("doc_id", T.tolerant_bool(words).alias("a"), T.tolerant_bool(F.col("toxic") == 1).alias("b"))


# C: vectors


@query(f"with {UNITS} select id, round(list_sum(list_transform(v, lambda x: x)) / n, 6) as total from u")
def c1_normalize(s, d):
    return vectors(s, d).select("id", F.round(F.aggregate(V.unit(F.col("vector")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"with {UNITS} select a.id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) as cosine from u a join u b on b.id::bigint = a.id::bigint + 1")
def c2_cosine(s, d):
    v = vectors(s, d).select("id", V.unit(F.col("vector")).alias("u"))
    nxt = v.select((F.col("id").cast("bigint") - 1).cast("string").alias("id"), F.col("u").alias("w"))
    return v.join(nxt, "id").select("id", F.round(V.cosine(F.col("u"), F.col("w")), 6).alias("cosine"))


@query(f"with {UNITS} select a.id as qid, b.id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) as similarity, (row_number() over (partition by a.id order by list_dot_product(a.v, b.v) / (a.n * b.n) desc, b.id) - 1)::int as rank from u a, u b qualify rank < 10")
def c3_search(s, d):
    v = vectors(s, d)
    return ST.VectorStore(v).search(v.select(F.col("id").alias("qid"), "vector"), 10).withColumn("similarity", F.round("similarity", 6))


@query("select doc_id::varchar as id, length(text) as n from documents where doc_id in (5, 3, 11)")
def c4_get_many(s, d):
    return ST.VectorStore(embedded(s, d)).get_many(["5", "3", "11"]).select("id", F.length("text").alias("n"))


@query(f"with {UNITS}, {PAIRS}, {KNN} select id, nbr, rank::int as rank, round(sim, 6) as sim from k")
def c5_knn_graph(s, d):
    return ST.VectorStore(vectors(s, d)).knn_graph().select("id", "nbr", F.round("sim", 6).alias("sim"), "rank")


@query(f"with {UNITS}, {PAIRS} select id, nbr, row_number() over (partition by id order by sim desc, nbr)::int as rank from p qualify rank <= 16")
def c6_neighbors(s, d):
    v = vectors(s, d)
    return ST.VectorStore(v).neighbors(v, 16).select("id", "nbr", "rank")


@query("select vec_id::varchar as id, len(embedding)::int as dim, embedding[1]::double as first from embeddings")
def c7_vector_of(s, d):
    store = ST.VectorStore(vectors(s, d))
    return store.vector_of(store.all_ids()).select("id", F.size("vector").alias("dim"), F.col("vector")[0].cast("double").alias("first"))


@query("with e as (select label as community, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select community, i, avg(x::double) as x from e group by all), n as (select community, max(case when i = 1 then x end) / sqrt(sum(x * x)) as c from m group by 1) select community, round(1 - c, 6) as distance from n order by 2, 1 limit 1")
def c8_nearest_centroid(s, d):
    v = vectors(s, d).withColumnRenamed("label", "community")
    return ST.nearest_centroid(v, [1.0] + [0.0] * 63).withColumn("distance", F.round("distance", 6))


@query()
def c9_lsh_neighbors(s, d):
    return ST.VectorStore(vectors(s, d)).approximate_neighbors(0.4)


# D: knowledge graph


@query(f"with {MENTIONS} select doc_id, pos::int as pos, mention from m")
def d1_mentions(s, d):
    return K.extract_mentions(documents(s, d), K.rule_extractor())


@query(f"with {COLLAPSE} select doc_id, c as canonical, mention, k as kept from kept")
def d2_collapse(s, d):
    return K.collapse_within(K.extract_mentions(documents(s, d), K.rule_extractor()))


@query(f"with {MENTIONS}, x as (select distinct mention, c from mc), c as (select distinct c from x), b as (select a.c, arg_max(b.c, {{'n': length(b.c), 'c': b.c}}) as l from c a join c b on length(b.c) > length(a.c) and contains(b.c, ' ') and contains(' ' || b.c || ' ', ' ' || a.c || ' ') group by 1) select mention, coalesce(l, x.c) as canonical from x left join b on b.c = x.c")
def d3_substring_links(s, d):
    return K.substring_links(K.extract_mentions(documents(s, d), K.rule_extractor()))


@query()
def d4_embedding_links(s, d):
    return K.embedding_links(K.extract_mentions(documents(s, d), K.rule_extractor()), lambda t: V.hashed_embedding(F.regexp_replace(t, "(?<=.)", " ")))


LINKED = f"with {MENTIONS}, l as (select mention, substring(c, 1, 6) as k from mc group by all), x as (select distinct doc_id, 'ent:' || k as node from m join l using (mention))"


@query(LINKED + " select doc_id, node from x")
def d5_linker(s, d):
    links = lambda m: m.select("mention", F.substring(T.canonicalize(F.col("mention")), 1, 6).alias("canonical")).distinct()
    return K.build(documents(s, d), links=links).mentions


@query(f"with {COLLAPSE} select canonical, node, label, in_graph from ents")
def d6_labels(s, d):
    return K.build(documents(s, d), eager=True).entities


@query(f"with {COLLAPSE} select node, kind from nodes")
def d7_nodes(s, d):
    return K.build(documents(s, d), eager=True).nodes.select("node", "kind")


@query(f"with {COLLAPSE} select src, dst, kind, weight from edges")
def d8_edges(s, d):
    return K.build(documents(s, d), eager=True).edges.select("src", "dst", "kind", "weight")


@query(f"with {COLLAPSE} select node, count(*) as docs, min(doc_id) as first from ment group by 1")
def d9_entity_docs(s, d):
    return K.build(documents(s, d)).mentions.groupBy("node").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


@query(f"with {COLLAPSE} select alias, node from alias")
def d10_aliases(s, d):
    return K.build(documents(s, d), eager=True).aliases


def first_words_model(prompt: str) -> str:
    """A stand-in for a language model: the first three words of the passage as a triple."""
    words = prompt.split("\n\n", 1)[1].split()
    if len(words) < 3:
        raise RuntimeError("nothing to say")
    return "```json\n" + json.dumps({"triples": [words[:3]]}) + "\n```"


WORDS = r"fw as (select doc_id::varchar as doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents)"
TRIPLES = f"{WORDS}, t as (select doc_id, {CANON.format('w[1]')} as s, w[2] as p, {CANON.format('w[3]')} as o from fw where len(w) >= 3), tc as (select * from t where s <> '' and o <> '')"


@query(f"with {WORDS} select count(distinct text) as answers from fw where len(w) >= 3")
def d11_call_model(s, d):
    return K.call_model(documents(s, d), first_words_model).agg(F.count("*").alias("answers"))


def _triples(s, d):
    docs = documents(s, d)
    return docs, K.triples(docs, stash(K.call_model(docs, first_words_model), "answers"))


@query(f"with {WORDS} select doc_id, 0 as pos, w[1] as s, w[2] as p, w[3] as o from fw where len(w) >= 3")
def d12_triples(s, d):
    return _triples(s, d)[1]


@query(f"with {TRIPLES}, e as (select least('ent:' || s, 'ent:' || o) as src, greatest('ent:' || s, 'ent:' || o) as dst, doc_id, p from tc) select src, dst, count(*) as weight, first(p order by doc_id) as first_predicate, count(distinct p)::int as predicates from e group by 1, 2")
def d13_relations(s, d):
    e = K.build_from_triples(*_triples(s, d)).edges.filter("kind = 'relates'")
    return e.select("src", "dst", "weight", F.col("predicates")[0].alias("first_predicate"), F.size("predicates").alias("predicates"))


@query(f"with {COLLAPSE}, {ASKED} select qid, pos::int as pos, mention, node from res")
def d14_resolve(s, d):
    return K.resolve(K.build(documents(s, d), eager=True), K.query_mentions(items(s, d), K.rule_extractor()))


@query(f"with {COLLAPSE}, {ASKED} select qid, pos::int as pos, mention from qm")
def d15_query_mentions(s, d):
    return K.query_mentions(items(s, d), K.rule_extractor())


@query()
def d16_hashed_embedder(s, d):
    return documents(s, d).select("id", F.round(V.norm(V.hashed_embedding(F.col("text"))), 6).alias("norm"))


# E: graphs

SUB = f"""with {UNITS}, {PAIRS}, {KNN}, h0 as (select id as qid, id as node, 0 as hop from u),
h1 as (select distinct qid, nbr as node, 1 as hop from h0 join k on k.id = h0.node where (qid, nbr) not in (select (qid, node) from h0)),
s1 as (select * from h0 union all select * from h1),
h2 as (select distinct qid, nbr as node, 2 as hop from h1 join k on k.id = h1.node where (qid, nbr) not in (select (qid, node) from s1)),
s2 as (select * from s1 union all select * from h2)"""


@query(SUB + ", e as (select distinct s2.qid, least(s2.node, nbr) as src, greatest(s2.node, nbr) as dst from s2 join k on k.id = s2.node join s2 b on b.qid = s2.qid and b.node = nbr), ec as (select qid, count(*) as edges from e group by 1), nc as (select qid, count(*) as nodes, count(*) filter (where hop = 2) as far from s2 group by 1) select qid, nodes, far, edges from nc join ec using (qid)")
def e1_induced_subgraph(s, d):
    v = vectors(s, d)
    knn = stash(ST.VectorStore(v).knn_graph(), "knn")
    nodes, edges = G.induced_subgraph(knn, v.select(F.col("id").alias("qid"), F.col("id").alias("node")))
    n = nodes.groupBy("qid").agg(F.count("*").alias("nodes"), F.count(F.when(F.col("hop") == 2, 1)).alias("far"))
    return n.join(edges.groupBy("qid").agg(F.count("*").alias("edges")), "qid")


@query()
def e2_communities(s, d):
    knn = stash(ST.VectorStore(vectors(s, d)).knn_graph(), "knn")
    return G.communities(knn.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).distinct())


KNNGRAPH = f"{UNITS}, {PAIRS}, {KNN}, ke as (select distinct least(id, nbr) as src, greatest(id, nbr) as dst from k), ks as (select src, dst from ke union all select dst, src from ke), kt as (select src, dst, 1.0::double / count(*) over (partition by src) as p from ks), ksd as (select label::varchar as qid, id as node from u)"


@query(f"with {KNNGRAPH}, {ppr_sql('kt', 'ksd', dangling=True)} select qid, node, round(mass, 8) as mass from pr")
def e4_pagerank(s, d):
    v = vectors(s, d)
    knn = stash(ST.VectorStore(v).knn_graph(), "knn")
    edges = knn.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).distinct()
    got = G.pagerank(G.transitions(edges), v.select(F.col("id").alias("node")), v.select(F.col("label").cast("string").alias("qid"), F.col("id").alias("node")), G.WalkConfig(dangling="restart"))
    return got.withColumn("mass", F.round("mass", 8))


def _transitions(s, d, gamma):
    path = N.weighted(K.build(documents(s, d), eager=True).incidence, s, gamma)
    return N.transitions(path, s).withColumn("p", F.round("p", 9))


@query(f"with {COLLAPSE} select src, dst, round(p, 9) as p from trans")
def e5_transitions(s, d):
    return _transitions(s, d, 0.0)


@query(f"with {COLLAPSE}, dg as (select src as node, count(*) as g from sym group by 1), hw as (select src, dst, w / case when src like 'ent:%' then ln(exp(1) + a.g) else 1 end / case when dst like 'ent:%' then ln(exp(1) + b.g) else 1 end as w from sym join dg a on a.node = src join dg b on b.node = dst) select src, dst, round(w / sum(w) over (partition by src), 9) as p from hw")
def e6_hub_discount(s, d):
    return _transitions(s, d, 1.0)


def _graph(s, d):
    return K.build(documents(s, d), eager=True).stashed()


def _seeds(s, d):
    kg = _graph(s, d)
    hit = K.resolve(kg, K.query_mentions(items(s, d), K.rule_extractor())).filter("node is not null")
    return kg, stash(hit.join(kg.nodes.select("node"), "node", "left_semi").groupBy("qid", "node").agg(F.min("pos").alias("pos")), "seeds")


SOLVED = f"with {COLLAPSE}, {ASKED}, {walk_sql()} select qid, node, round(coalesce(mass, 0), 8) as mass from (select distinct qid from seeds) cross join (select node from nodes) left join pr using (qid, node)"


@query(SOLVED)
def e7_solve(s, d):
    kg, seeds = _seeds(s, d)
    return N.walks(N.weighted(kg.incidence, s), seeds, G.WalkConfig(), every=True).withColumn("mass", F.round("mass", 8))


@query(SOLVED)
def e8_solve_multi(s, d):
    """The same through the planner's graph."""
    kg, seeds = _seeds(s, d)
    p = PL.Planner(ST.VectorStore(vectors(s, d)), kg=kg)
    return N.walks(p.net, seeds, G.WalkConfig(), every=True).withColumn("mass", F.round("mass", 8))


def bfs_sql(hops: int) -> str:
    """Breadth first from the seeds by the incidence of documents and entities: CTE v(qid, node, path)."""
    out = [
        "inc as (select 'doc:' || doc_id as d, node as e from ment)",
        "s0 as (select qid, node, row_number() over (partition by qid order by pos, node) as ord from seeds)",
        "f0 as (select qid, node, lpad(ord::varchar, 9, '0') as key, [node] as path from s0), v0 as (select qid, node, path from f0)",
    ]
    for k in range(hops):
        out += [
            f"g{k} as materialized (select qid, d, min(key) as key from f{k} join inc on inc.e = f{k}.node group by all)",
            f"h{k} as materialized (select qid, e as node, min(key) as key from (select * from g{k} union all select qid, node, key from f{k} where node like 'doc:%') join inc using (d) group by all union all select qid, d, key from g{k})",
            f"f{k + 1} as materialized (select h{k}.qid, h{k}.node, h{k}.node as key, list_append(f{k}.path, h{k}.node) as path from h{k} join f{k} on f{k}.qid = h{k}.qid and f{k}.key = h{k}.key where not exists (select 1 from v{k} where v{k}.qid = h{k}.qid and v{k}.node = h{k}.node))",
            f"v{k + 1} as (select * from v{k} union all select qid, node, path from f{k + 1})",
        ]
    return ",\n".join(out) + f", v as (select * from v{hops})"


@query(f"with {COLLAPSE}, {ASKED}, {bfs_sql(3)} select qid, node as target, array_to_string(path, ' > ') as path, (len(path) - 1)::int as hops from v where node like 'doc:%'")
def e9_shortest_paths(s, d):
    kg, seeds = _seeds(s, d)
    return N.all_paths(N.weighted(kg.incidence, s), seeds, None, 3).withColumn("path", F.array_join("path", " > "))


@query(f"with {COLLAPSE}, {ASKED}, {bfs_sql(3)}, {walk_sql().replace('inc as (select', 'inc2 as (select', 1)}, sc as (select v.qid, v.node as target, len(path) - 1 as hops, round(coalesce(mass, 0) / len(path), 12) as score from v left join pr on pr.qid = v.qid and pr.node = v.node where v.node like 'doc:%' and len(path) > 1) select qid, target, hops::int as hops, round(score, 8) as score from sc qualify row_number() over (partition by qid order by score desc, hops, target) <= 5")
def e10_reasoning_paths(s, d):
    kg, seeds = _seeds(s, d)
    best = N.best_paths(N.weighted(kg.incidence, s), seeds, G.WalkConfig(), 3, 5, 12)
    return best.select("qid", "target", "hops", F.round("score", 8).alias("score"))


@query(f"with {COLLAPSE}, x as (select e.node as qid, dst as neighbor, w as weight from ents e join sym on sym.src = e.node where in_graph) select qid, kind, neighbor, weight, row_number() over (partition by qid, kind order by weight desc, neighbor)::int as rank from x join nodes on nodes.node = neighbor qualify rank <= 20")
def e11_entity_neighbors(s, d):
    return N.neighbors(K.build(documents(s, d), eager=True).incidence, s)


@query()
def e12_path_between(s, d):
    """Routes between the first two names of every benchmark item that has two."""
    p = PL.Planner(ST.VectorStore(vectors(s, d)), kg=_graph(s, d))
    m = K.query_mentions(items(s, d), K.rule_extractor()).groupBy("qid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mention"))), lambda x: x["mention"])).alias("m"))
    pairs = m.filter("size(m) > 1").select("qid", F.col("m")[0].alias("entity_a"), F.col("m")[1].alias("entity_b"))
    return p.path_between(pairs).select("qid", "error", "connected", "rank", F.array_join("path", " > ").alias("path"), "hops", "via_documents")


@query(f"with {COLLAPSE}, {ASKED}, {bfs_sql(3).replace('from seeds)', 'from (select a.qid, a.node, 0 as pos from seeds a where pos = (select min(pos) from seeds b where b.qid = a.qid)))', 1)} select qid, count(*) filter (where len(path) = 2) as one, count(*) filter (where len(path) = 3) as two, count(*) filter (where len(path) = 4) as three from v group by qid")
def e12_distances(s, d):
    """How many nodes lie one, two and three hops from the first seed of each item."""
    kg, seeds = _seeds(s, d)
    first = seeds.groupBy("qid").agg(F.min_by("node", F.struct("pos", "node")).alias("node")).withColumn("pos", F.lit(0))
    got = N.distances(N.weighted(kg.incidence, s), first, 3)
    at = lambda k: F.sum(F.when(F.col("hops") == k, F.col("n")).otherwise(0))
    return got.groupBy("qid").agg(at(1).alias("one"), at(2).alias("two"), at(3).alias("three"))


@query(f"with {COLLAPSE}, dg as (select src as node, count(*) as g from sym where src like 'ent:%' group by 1 order by 2 desc, 1 limit 10) select 'documents' as name, count(*) as value, 0 as rank from documents union all select 'entities', count(*), 0 from ents where in_graph union all select 'edges', count(*), 0 from edges union all select node, g, row_number() over (order by g desc, node)::int from dg")
def e13_graph_stats(s, d):
    kg = K.build(documents(s, d), eager=True)
    return G.graph_stats(kg.nodes, None, degree=stash(N.degrees(kg.incidence, s).select("node", "degree"), "degrees"))


@query(f"with {COLLAPSE} select src, dst, weight from co")
def e14_entity_subgraph(s, d):
    return G.entity_subgraph(K.build(documents(s, d), eager=True).edges).select("src", "dst", "weight")


@query(f"with {COLLAPSE}, {ASKED} select qid, mention, res.node, label from res left join ents on ents.node = res.node")
def e15_resolve_entities(s, d):
    kg = K.build(documents(s, d), eager=True)
    got = K.resolve(kg, K.query_mentions(items(s, d), K.rule_extractor()))
    return got.join(kg.entities.select("node", "label"), "node", "left").select("qid", "mention", "node", "label")


# F: scores and packing

MM = "case when max({0}) over w - min({0}) over w < 1e-9 then 0.5 else ({0} - min({0}) over w) / nullif(max({0}) over w - min({0}) over w, 0) end"
LINES = f"li as (select l_orderkey as qid, l_partkey || '/' || l_linenumber as node, l_extendedprice as r, l_quantity as s, case when l_tax > 0.02 then l_discount end as c from lineitem), mm as (select *, {MM.format('r')} as a, {MM.format('s')} as b, case when c is null then 0 else {MM.format('c')} end as e from li window w as (partition by qid))"


def components(s, d):
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("qid"), F.concat_ws("/", "l_partkey", "l_linenumber").alias("node"), F.col("l_extendedprice").alias("relevance"), F.col("l_quantity").alias("structural"), F.when(F.col("l_tax") > 0.02, F.col("l_discount")).alias("coherence")
    )


@query(f"with {LINES} select qid, node, round(a, 6) as value from mm")
def f1_minmax(s, d):
    return components(s, d).select("qid", "node", F.round(S.minmax(F.col("relevance"), "qid"), 6).alias("value"))


@query(f"with {UNITS}, q as (select 'q' || id as qid, v, n from u), x as (select qid, u.id as node, list_dot_product(u.v, q.v) / (u.n * q.n) as cosine from u, q) select qid, node, round({MM.format('cosine')}, 5) as relevance from x window w as (partition by qid)")
def f2_relevance(s, d):
    v = vectors(s, d)
    q = v.select(F.concat(F.lit("q"), "id").alias("qid"), "vector")
    return ST.VectorStore(v).relevance(q).select("qid", "node", F.round("relevance", 5).alias("relevance"))


@query(f"with {KNNGRAPH} select u.id as node, round(coalesce(avg(case when b.label = 3 then 1.0::double else 0 end), 0), 6) as coherence from u left join ks on ks.src = u.id left join u b on b.id = ks.dst group by 1")
def f3_coherence(s, d):
    v = vectors(s, d)
    knn = ST.VectorStore(v).knn_graph()
    edges = knn.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).distinct()
    return S.coherence(edges, v.select(F.col("id").alias("node")), v.filter("label = 3").select(F.col("id").alias("node"))).withColumn("coherence", F.round("coherence", 6))


@query(f"with {LINES} select qid, node, round((3 * a + b + e) / 5, 6) as score from mm")
def f4_composite_sum(s, d):
    return S.composite(components(s, d)).select("qid", "node", F.round("score", 6).alias("score"))


@query(f"with {LINES} select qid, node, round(exp((3 * ln(1e-9::double + a) + ln(1e-9::double + b) + ln(1e-9::double + e)) / 5), 6) as score from mm")
def f5_composite_geom(s, d):
    return S.composite(components(s, d), integration="geom").select("qid", "node", F.round("score", 6).alias("score"))


@query("select l_partkey as qid, l_suppkey::varchar as node, round(exp(avg(ln(1e-12::double + l_discount))), 8) as value from lineitem group by 1, 2")
def f6_convergence(s, d):
    x = table(s, d, "lineitem").select(F.col("l_partkey").alias("qid"), F.col("l_suppkey").cast("string").alias("node"), F.col("l_linenumber").alias("grp"), F.col("l_discount").alias("mass"))
    return S.convergence(x).withColumn("value", F.round("value", 8))


@query(f"with li as (select l_orderkey as qid, l_partkey || '/' || l_linenumber as node, l_extendedprice as r from lineitem where (l_orderkey, l_partkey, l_linenumber) not in (select (l_orderkey, l_partkey, l_linenumber) from lineitem where l_returnflag = 'A')), x as (select qid, node, {MM.format('r')} as v from li window w as (partition by qid)) select qid, node, round(v, 6) as value from x")
def f8_exclude_before(s, d):
    out = table(s, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("qid"), F.concat_ws("/", "l_partkey", "l_linenumber").alias("node"))
    return components(s, d).join(out, ["qid", "node"], "left_anti").select("qid", "node", F.round(S.minmax(F.col("relevance"), "qid"), 6).alias("value"))


@query(f"with {LINES} select qid, node, (row_number() over (partition by qid order by round((3 * a + b + e) / 5, 9) desc, node) - 1)::int as rank from mm")
def f9_ranked(s, d):
    scored = S.composite(components(s, d)).withColumn("score", F.round("score", 9))
    return S.ranked(scored).select("qid", "node", "rank")


def fit_sql(ranked: str, consider: int = 50, budget: int = 4000) -> str:
    """First fit into the budget without near copies, a row after the other: CTE fit(qid, node, rank, tokens, took) of `ranked`(qid, node, rank, tokens, score, v)."""
    close = "coalesce(list_max(list_transform(fit.vs, lambda x: list_dot_product(x, r.v))), -1)"
    took = f"(used + r.tokens <= {budget} and not ({close} > 0.95 and 0.7::double * r.score - 0.3::double * {close} < 0))"
    return f"""fit as (select qid, node, rank, tokens, score, tokens <= {budget} as took, case when tokens <= {budget} then tokens else 0 end as used, case when tokens <= {budget} then [v] else [] end as vs from {ranked} where rank = 0
union all select r.qid, r.node, r.rank, r.tokens, r.score, {took}, case when {took} then used + r.tokens else used end, case when {took} then list_append(vs, r.v) else vs end from fit join {ranked} r on r.qid = fit.qid and r.rank = fit.rank + 1 where r.rank < {consider})"""


VECS = "uv as (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings)"
DOCRANK = f"{VECS}, dr as (select source as qid, doc_id::varchar as node, text, greatest(1, length(text) // 4) as tokens, v, (n_chars % 97) / 97.0::double as score, (row_number() over (partition by source order by n_chars % 97 desc, doc_id::varchar) - 1)::int as rank from documents join uv on vec_id = doc_id % 20)"
FIRSTFIT = f"with recursive {DOCRANK}, {fit_sql('dr')}, taken as (select fit.*, text from fit join dr using (qid, node) where took)"


def _packed(s, d):
    v = vectors(s, d).select(F.col("id").cast("bigint").alias("n"), "vector")
    x = table(s, d, "documents").select(F.col("source").alias("qid"), F.col("doc_id").cast("string").alias("node"), "text", ((F.col("n_chars") % 97) / 97).alias("score"), (F.col("doc_id") % 20).alias("n"))
    return P.pack(S.ranked(x.join(v, "n")))


@query(FIRSTFIT + " select qid, node, rank, tokens::int as tokens, row_number() over (partition by qid order by rank)::int as position from taken")
def f11_pack(s, d):
    return _packed(s, d).select("qid", "node", "rank", "tokens", "position")


@query(FIRSTFIT + ", n as (select qid, text, row_number() over (partition by qid order by rank) as position from taken) select qid, string_agg('[' || position || '] ' || text, chr(10) || chr(10) order by position) as context from n group by 1")
def f12_context(s, d):
    return P.context(_packed(s, d))


@query(FIRSTFIT + ", n as (select qid, node, row_number() over (partition by qid order by rank)::int as position from taken) select qid, node, position from n where position <= 10")
def f13_sources(s, d):
    return _packed(s, d).filter("position <= 10").select("qid", "node", "position")


# G: planner


def _planner(s, d, **config):
    return PL.Planner(ST.VectorStore(embedded(s, d)), config=PL.PlannerConfig(**config), kg=_graph(s, d))


def _by_id(s, d):
    """Every benchmark item with a vector."""
    return _numbered(s, d, items(s, d).withColumn("number", F.col("qid").cast("bigint")), "number").drop("label")


DOCVECS = f"{VECS}, nv as (select count(*) as n from embeddings), q as (select item_id::varchar as qid, v from benchmark, nv join uv on vec_id = item_id % n), dv as (select doc_id::varchar as id, text, v from documents, nv join uv on vec_id = doc_id % n)"


def minmax_sql(x: str) -> str:
    return f"(case when max({x}) over w - min({x}) over w < 1e-9 then 0.5 else ({x} - min({x}) over w) / nullif(max({x}) over w - min({x}) over w, 0) end)"


def graph_mode_sql(converge: bool) -> str:
    """Graph mode: CTE ranked(qid, node, r, s, c, score, rank). Queries without a seed fall back to entities of their nearest documents."""
    out = f"""{COLLAPSE}, {ASKED}, {DOCVECS},
near as (select qid, dv.id, row_number() over (partition by qid order by round(list_dot_product(q.v, dv.v), 12) desc, dv.id) as k from q, dv where qid not in (select qid from seeds)),
fb as (select qid, node, min(k) as k from near join ment on ment.doc_id = near.id where k <= 3 group by all), fs as (select qid, node, row_number() over (partition by qid order by k, node) as pos from fb qualify pos <= 8),
sq as (select qid, node, pos from seeds where qid in (select qid from q) union all select qid, node, pos from fs), {walk_sql('sq')}"""
    if converge:
        out += f""",
first as (select qid, node, count(*) over (partition by qid) as n, row_number() over (partition by qid order by pos, node) as k from sq qualify n > 1 and k <= 4),
one as (select distinct node as qid, node from first), {walk_sql('one', 'sg').replace('inc as (', 'inc2 as (', 1).replace('nd as (', 'nd2 as (', 1).replace('ne as (', 'ne2 as (', 1)},
lo as (select first.qid, sg.node, sum(ln(1e-12::double + mass) - ln(1e-12::double)) as more from first join sg on sg.qid = first.node where sg.node like 'doc:%' group by all),
fn as (select qid, count(*) as n from first group by qid)"""
    c = "case when fn.n is null then 1 else exp(ln(1e-12::double) + coalesce(more, 0) / fn.n) end" if converge else "1.0::double"
    joins = " left join fn on fn.qid = q.qid left join lo on lo.qid = q.qid and lo.node = 'doc:' || dv.id" if converge else ""
    total = "(3 * {0} + {1} + {2}) / 5" if converge else "(3 * {0} + {1}) / 4"
    score = total.format(*(minmax_sql(x) for x in "rsc"))
    return out + f""",
x as (select q.qid, dv.id as node, list_dot_product(q.v, dv.v) as r, coalesce(pr.mass, 0) as s, {c} as c from q cross join dv left join pr on pr.qid = q.qid and pr.node = 'doc:' || dv.id{joins}),
sc as (select *, {score} as score from x window w as (partition by qid)),
ranked as materialized (select *, (row_number() over (partition by qid order by round(score, 12) desc, node) - 1)::int as rank from sc)"""


def sources_sql(top_k: int) -> str:
    """What graph mode packs: CTE src(qid, position, node, text, r, s, score)."""
    return f"""with recursive {graph_mode_sql(True)},
top as (select qid, node, r, s, score, rank, text, v, greatest(1, length(text) // 4) as tokens from ranked join dv on dv.id = ranked.node where rank < {5 * top_k}), {fit_sql('top', 5 * top_k)},
src as (select qid, row_number() over (partition by qid order by rank)::int as position, node, top.text, r, s, top.score from fit join top using (qid, node, rank) where took qualify position <= {top_k})"""


NEIGHBORS = f"""with {DOCVECS},
kp as (select a.id, b.id as nbr, row_number() over (partition by a.id order by round(list_dot_product(a.v, b.v), 12) desc, b.id) as rank from dv a join dv b on a.id <> b.id qualify rank <= 10),
ann as (select qid, id as node, list_dot_product(q.v, dv.v) as sim, row_number() over (partition by qid order by round(list_dot_product(q.v, dv.v), 12) desc, id) as k from q, dv qualify k <= 10),
h0 as (select qid, node, 0 as hop from ann), h1 as (select distinct qid, nbr as node, 1 as hop from h0 join kp on kp.id = h0.node where (qid, nbr) not in (select (qid, node) from h0)), s1 as (select * from h0 union all select * from h1),
h2 as (select distinct qid, nbr as node, 2 as hop from h1 join kp on kp.id = h1.node where (qid, nbr) not in (select (qid, node) from s1)),
nn as (select qid, node from (select * from s1 union all select * from h2) qualify row_number() over (partition by qid order by hop, node) <= 2000),
ee as (select distinct a.qid, least(a.node, nbr) as src, greatest(a.node, nbr) as dst from nn a join kp on kp.id = a.node join nn b on b.qid = a.qid and b.node = nbr),
es as (select qid || ' ' || src as src, qid || ' ' || dst as dst from ee union all select qid || ' ' || dst, qid || ' ' || src from ee), et as (select src, dst, 1.0::double / count(*) over (partition by src) as p from es),
sn as (select qid, qid || ' ' || node as node from ann where k <= 5), {ppr_sql('et', 'sn', dangling=True)},
xx as (select nn.qid, nn.node, list_dot_product(q.v, dv.v) as cosine, coalesce(mass, 0) as s from nn join q using (qid) join dv on dv.id = nn.node left join pr on pr.qid = nn.qid and pr.node = nn.qid || ' ' || nn.node),
yy as (select qid, node, s, 1.0::double as c, {minmax_sql('cosine')} as r from xx window w as (partition by qid)),
zz as (select qid, node, (3 * {minmax_sql('r')} + {minmax_sql('s')} + {minmax_sql('c')}) / 5 as score from yy window w as (partition by qid))
select qid, node, (row_number() over (partition by qid order by round(score, 12) desc, node) - 1)::int as rank, round(score, 5) as score from zz qualify rank < 10"""


@query(NEIGHBORS)
def g4_neighbor_mode(s, d):
    got = PL.Planner(ST.VectorStore(embedded(s, d))).retrieve(_by_id(s, d).drop("text"))
    return got.scored.filter("rank < 10").select("qid", "node", F.col("rank").cast("int").alias("rank"), F.round("score", 5).alias("score"))


@query(f"with {graph_mode_sql(False)} select qid, node, rank, round(score, 5) as score from ranked where rank < 50")
def g5_graph_mode(s, d):
    """The 50 best of each query without convergence."""
    got = _planner(s, d, use_convergence=False).retrieve(_by_id(s, d), explain=False)
    return got.scored.select("qid", "node", "rank", F.round("score", 5).alias("score"))


@query(f"with {graph_mode_sql(True)} select qid, node, round(r, 5) + 0 as relevance, round(s, 7) as structural, round(score, 5) as score from ranked")
def g5_every_score(s, d):
    """All scores with the planner's defaults."""
    got = _planner(s, d).retrieve(_by_id(s, d), explain=False, everything=True)
    return got.scored.select("qid", "node", (F.round("relevance", 5) + F.lit(0.0)).alias("relevance"), F.round("structural", 7).alias("structural"), F.round("score", 5).alias("score"))


@query(sources_sql(10) + " select qid, position, node, round(score, 4) as score from src")
def g5_graph_mode_defaults(s, d):
    got = _planner(s, d).retrieve(_by_id(s, d))
    return got.sources.select("qid", "position", "node", F.round("composite_score", 4).alias("score"))


@query()
def g8_iterate(s, d):
    """Two hops, the second also from the entity that most documents mention."""
    q, p = _by_id(s, d), _planner(s, d)
    hub = p.kg.mentions.groupBy("node").count().orderBy(F.desc("count"), "node").join(p.kg.entities, "node").select("label").first()
    a, b = p.iterate([(q, []), (q, [hub.label] if hub else [])], top_k=3)
    return a.sources.withColumn("hop", F.lit(1)).unionByName(b.sources.withColumn("hop", F.lit(2))).select("hop", "qid", "node")


@query(sources_sql(8) + ", used as (select qid, string_agg(node, ' ' order by pos, node) as seeds_used from sq group by qid) select qid, position, node as id, substring(text, 1, 280) as snippet, round(score, 4) as score, round(r, 4) + 0 as cosine, round(s, 6) as graph_score, coalesce(seeds_used, '') as seeds_used from src left join used using (qid)")
def g9_retrieve_tool(s, d):
    p = _planner(s, d)
    view = p.tool_view(p.retrieve(_by_id(s, d), top_k=8))
    return view.select("qid", F.explode("sources").alias("s"), F.array_join("seeds_used", " ").alias("seeds_used")).select("qid", "s.*", "seeds_used").withColumn("cosine", F.col("cosine") + F.lit(0.0))


# H: evaluation

BASKETS = "bk as (select o_custkey as qid, list(o_orderkey order by o_totalprice desc, o_orderkey) as ids, coalesce(list(o_orderkey order by o_orderkey) filter (where o_orderpriority like '1%'), []) as gold, min(o_orderkey) % 3 + 2 as n_hops from orders group by 1)"
REC = "(case when len(gold) > 0 then len(list_intersect(ids[1:{0}], gold))::double / len(gold) end)"


def _baskets(s, d):
    o = table(s, d, "orders")
    by = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["k"])
    return o.groupBy(F.col("o_custkey").alias("qid")).agg(
        by(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k"))).alias("ids"),
        F.array_sort(F.collect_list(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderkey")))).alias("gold"),
        (F.min("o_orderkey") % 3 + 2).alias("n_hops"),
    )


@query(f"with {BASKETS} select qid, round({REC.format(2)}, 6) as r2, round({REC.format(10)}, 6) as r10 from bk")
def h1_recall(s, d):
    return _baskets(s, d).select("qid", *(F.round(E.recall(F.col("ids"), F.col("gold"), k), 6).alias(f"r{k}") for k in (2, 10)))


@query(f"with {BASKETS} select qid, len(list_filter(gold, lambda x: x % 2 = 0))::int as n from bk")
def h2_retrievable_gold(s, d):
    pool = table(s, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("title"))
    q = _baskets(s, d).select("qid", F.col("gold").cast("array<string>").alias("gold"))
    return E.retrievable_gold(q, pool.select(F.col("title").cast("string").alias("title"))).select("qid", F.size("gold").alias("n"))


def _two(s, d):
    b = _baskets(s, d)
    r = b.select("qid", "ids")
    return r.withColumn("strategy", F.lit("price")).unionByName(r.select("qid", F.array_sort("ids").alias("ids")).withColumn("strategy", F.lit("number"))), b.select("qid", "gold", "n_hops")


TWO = f"{BASKETS}, tw as (select 'price' as strategy, qid, ids, gold, n_hops from bk union all select 'number', qid, list_sort(ids), gold, n_hops from bk), mr as (select strategy, k, avg(case k when 2 then {REC.format(2)} when 5 then {REC.format(5)} else {REC.format(10)} end) as recall, count(*) as n from tw, (values (2), (5), (10)) v(k) where len(gold) > 0 group by all)"


@query(f"with {TWO} select strategy, k, round(recall, 6) as recall, n from mr")
def h3_mean_recall(s, d):
    return E.mean_recall(*_two(s, d)).withColumn("recall", F.round("recall", 6))


@query(f"with {TWO} select a.k, round(100 * (b.recall - a.recall), 4) as points from mr a join mr b on a.k = b.k and a.strategy = 'number' and b.strategy = 'price'")
def h3_delta_points(s, d):
    return E.delta_points(E.mean_recall(*_two(s, d)), "number", "price").withColumn("points", F.round("points", 4))


@query(f"with {TWO} select strategy, n_hops, round(avg({REC.format(10)}), 6) as recall, count(*) as n from tw where len(gold) > 0 group by rollup (strategy, n_hops) having strategy is not null")
def h4_per_hop(s, d):
    return E.per_hop(*_two(s, d)).withColumn("recall", F.round("recall", 6))


@query(f"""with {COLLAPSE}, {ASKED}, {DOCVECS}, {walk_sql(documents=False)},
mn as (select qid, doc_id as node, round(avg(coalesce(mass, 0)), 12) as score from (select distinct qid from seeds) cross join ment left join pr using (qid, node) group by all),
fi as (select qid, node, 0 as pass, row_number() over (partition by qid order by score desc, node) as k from mn qualify k <= 10 union all
  select qid, id, 1, row_number() over (partition by qid order by round(list_dot_product(q.v, dv.v), 12) desc, id) as k from q, dv qualify k <= 30),
al as (select qid, node, min(pass * 100 + k) as k from fi group by all)
select qid, node, (row_number() over (partition by qid order by k, node) - 1)::int as rank from al qualify rank < 10""")
def h6_entity_mean(s, d):
    kg, seeds = _seeds(s, d)
    return PL.entity_mean_retrieve(kg, ST.VectorStore(embedded(s, d)), _by_id(s, d), seeds).withColumn("rank", F.col("rank").cast("int"))


@query()
def h7_ablation(s, d):
    return _planner(s, d).ablation(_by_id(s, d))


@query("select round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95 from events")
def h8_latency(s, d):
    got = E.latency(table(s, d, "events").select(F.col("value").alias("ms")))
    return got.select(*(F.round(c, 6).alias(c) for c in ("mean", "median", "p95")))


@query("with c as (select l_orderkey as qid, l_linenumber as pos, case when l_partkey % 2 = 0 then p_name end as name, l_suppkey as file, coalesce(case when l_partkey % 2 = 0 then p_name end, s_name) as t from lineitem left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey), n as (select qid, t, row_number() over (partition by qid order by pos, name nulls first, file, t) as k from c), f as (select qid, t, min(k) as k from n group by all) select qid, string_agg(t, '|' order by k) as titles from f group by 1")
def h9_attribute_chunks(s, d):
    chunks = table(s, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("part"), F.col("l_suppkey").alias("file"))
    parts = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    chunks = chunks.join(parts, chunks["part"] == parts["id"], "left").drop("id")
    files = table(s, d, "supplier").select(F.col("s_suppkey").alias("filename"), F.col("s_name").alias("title"))
    got = E.attribute_chunks(chunks, parts.select(F.col("name").alias("title")).distinct(), files, ["name"], ["file"])
    return got.select("qid", F.array_join("titles", "|").alias("titles"))


@query(f"with {BASKETS} select count(*) as questions, count(*) filter (where ids[1:10] = list_sort(ids)[1:10]) as identical from bk")
def h10_identical_passes(s, d):
    r, _ = _two(s, d)
    return E.identical_passes(r.select(F.col("strategy").alias("pass"), "qid", "ids"))


@query("select item_id::varchar as qid from benchmark order by md5('0:' || item_id), 1 limit 20")
def h11_sample_questions(s, d):
    return E.sample_questions(items(s, d), 20).select("qid")


