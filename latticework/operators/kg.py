"""Building a document-entity knowledge graph from mentions or from triples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.text import canonicalize, content_key, doc_node, entity_node, fill_prompt, parse_triples, strip, token_contained
from latticework.operators import net
from latticework.session import stash

LABELS = ("PERSON", "ORG", "GPE", "LOC", "NORP", "FAC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE")
PROMPT = "List the facts of the passage as JSON, {\"triples\": [[subject, predicate, object], ...]}.\n\n{passage}"


class KnowledgeGraph:
    """nodes(node, kind, doc_id, canonical, label), edges(src < dst, kind, weight, predicates), mentions(doc_id, node),
    entities(canonical, node, label, in_graph) and aliases(alias, node).

    co_occurs: whether the entity edges are the co-occurrences of the mentions
    and nothing else, None if that is not known. If they are, edges may be left
    out: tasks make them from the incidence of documents and entities. names:
    the column `node` of nodes, where that is cheaper to have.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame | None, mentions: DataFrame, entities: DataFrame, aliases: DataFrame, co_occurs: bool | None = None, names: DataFrame | None = None) -> None:
        self.nodes, self.mentions, self.entities, self.aliases, self.co_occurs = nodes, mentions, entities, aliases, co_occurs
        self._edges, self._names = edges, nodes if names is None else names
        self._incidence: str | None = None

    @property
    def incidence(self) -> str:
        """Documents and entities as arrays in the shared folder, written once."""
        if self._incidence is None:
            self._incidence = net.incidence(self._names, self.mentions)
        return self._incidence

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            none = F.lit(None).cast("array<string>").alias("predicates")
            co = net.cooccurrences(self.incidence, self.nodes.sparkSession).select("src", "dst", F.lit("co_occurs").alias("kind"), "weight", none)
            self._edges = mention_edges(self.mentions).unionByName(co)
        return self._edges

    def stashed(self) -> KnowledgeGraph:
        """The same with its tables computed once, but for edges that follow from the mentions."""
        keep = lambda t: self._edges if t == "edges" and self.co_occurs else stash(getattr(self, t), f"kg-{t}")
        return KnowledgeGraph(*(keep(t) for t in ("nodes", "edges", "mentions", "entities", "aliases")), self.co_occurs)


def rule_extractor(letters: int = 2) -> Callable[[Column], Column]:
    """Runs of capitalised words of so many letters, of any alphabet that has capitals, as mentions: an extractor without a model."""
    word = rf"\p{{Lu}}\p{{L}}{{{letters - 1},}}"
    return lambda text: F.transform(F.regexp_extract_all(text, F.lit(f"{word}(?: {word})*"), F.lit(0)), lambda m: F.struct(m.alias("text"), F.lit("ORG").alias("label")))


def extract_mentions(docs: DataFrame, extractor: Callable[[Column], Column], min_len: int = 2) -> DataFrame:
    """docs(id, text): (doc_id, pos, mention), repeats and order kept; other labels and short mentions dropped."""
    m = docs.select(F.col("id").cast("string").alias("doc_id"), F.posexplode(extractor(F.col("text"))).alias("pos", "m"))
    m = m.filter(F.col("m.label").isin(*LABELS)).select("doc_id", "pos", strip(F.col("m.text")).alias("mention"))
    return m.filter(F.length("mention") >= min_len)


def collapse_within(mentions: DataFrame) -> DataFrame:
    """Per document, mentions whose words occur in a longer kept one go with it: (doc_id, canonical, mention, kept).

    Containment is transitive, so a canonical stays if no longer one of the
    document contains it, and goes with the longest that does. Candidates share
    a word in a document, found by an index of words, so not all pairs are compared.
    """
    m = mentions.select("doc_id", "mention", canonicalize(F.col("mention")).alias("canonical")).filter("canonical <> ''").distinct()
    c = m.select("doc_id", "canonical").distinct()
    first = c.select("doc_id", "canonical", F.split("canonical", " ")[0].alias("w"))
    words = c.filter(F.contains("canonical", F.lit(" "))).select("doc_id", F.col("canonical").alias("long"), F.explode(F.array_distinct(F.split("canonical", " "))).alias("w"))
    hit = first.join(words, ["doc_id", "w"]).filter((F.col("canonical") != F.col("long")) & token_contained(F.col("canonical"), F.col("long")))
    longest = hit.groupBy("doc_id", "canonical").agg(F.max(F.struct(F.length("long").alias("n"), F.col("long"))).alias("best"))
    return m.join(longest, ["doc_id", "canonical"], "left").select("doc_id", "canonical", "mention", F.coalesce("best.long", "canonical").alias("kept"))


def substring_links(mentions: DataFrame) -> DataFrame:
    """Over the whole corpus: (mention, canonical), each bound to the longest canonical that contains its words.

    Candidates share a word, found by an index of words, so not all pairs are compared.
    """
    m = mentions.select("mention", canonicalize(F.col("mention")).alias("c")).filter("c <> ''").distinct()
    c = m.select("c").distinct()
    first = c.select("c", F.element_at(F.split("c", " "), 1).alias("w"))
    words = c.select(F.col("c").alias("long"), F.explode(F.array_distinct(F.split("c", " "))).alias("w"))
    hit = first.join(words, "w").filter(F.length("long") > F.length("c")).filter(token_contained(F.col("c"), F.col("long")))
    best = hit.groupBy("c").agg(F.max_by("long", F.struct(F.length("long"), F.col("long"))).alias("long"))
    return m.join(best, "c", "left").select("mention", F.coalesce("long", "c").alias("canonical"))


def embedding_links(mentions: DataFrame, embed: Callable[[Column], Column], threshold: float = 0.82) -> DataFrame:
    """Greedy leader clustering of canonicals, longest first: (mention, canonical).

    Each joins the first leader whose cosine reaches the threshold. The result
    depends on that order, so the clustering runs in one task over the distinct
    canonicals, which are streamed to it; it holds the leaders.
    """
    m = mentions.select("mention", canonicalize(F.col("mention")).alias("c")).filter("c <> ''").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders, names = np.zeros((0, 0)), []
        for f in frames:
            out = []
            for c, v in zip(f["c"], f["v"]):
                v = np.asarray(v, float)
                v = v / max(np.linalg.norm(v), 1e-12)
                near = np.flatnonzero(leaders[: len(names)] @ v >= threshold) if names else []
                if len(near):
                    out.append((c, names[near[0]]))
                    continue
                if len(names) == len(leaders):  # doubled, so that rows are copied a few times at most
                    leaders = np.concatenate([leaders, np.zeros_like(leaders)]) if names else np.zeros((64, len(v)))
                leaders[len(names)] = v
                names.append(c)
                out.append((c, c))
            yield pd.DataFrame(out, columns=["c", "canonical"])

    names = m.select("c").distinct().repartition(1).sortWithinPartitions(F.length("c").desc(), "c")
    links = names.select("c", embed(F.col("c")).alias("v")).mapInPandas(run, "c string, canonical string")
    return m.join(links, "c").select("mention", "canonical")


def _bundle(docs: DataFrame, kept: DataFrame, displays: DataFrame, extra: DataFrame | None) -> KnowledgeGraph:
    """kept(doc_id, canonical): entities of documents; displays(canonical, display): every surface form."""
    ids = docs.select(F.col("id").cast("string").alias("doc_id")).distinct()
    mentions = kept.select("doc_id", entity_node(F.col("canonical")).alias("node")).distinct()
    label = displays.groupBy("canonical").agg(F.max_by("display", F.struct(F.length("display"), F.col("display"))).alias("label"))
    graph = kept.select("canonical").distinct().withColumn("in_graph", F.lit(True))
    entities = label.join(graph, "canonical", "left").select("canonical", entity_node(F.col("canonical")).alias("node"), "label", F.coalesce("in_graph", F.lit(False)).alias("in_graph"))
    nodes = ids.select(doc_node(F.col("doc_id")).alias("node"), F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("string").alias("label")).unionByName(
        entities.filter("in_graph").select("node", F.lit("entity").alias("kind"), F.lit(None).cast("string").alias("doc_id"), "canonical", "label")
    )
    edges = None if extra is None else mention_edges(mentions).unionByName(extra)
    own = entities.filter("in_graph").select(F.col("canonical").alias("alias"), F.lit(0).alias("pass"), "canonical", F.lit("").alias("display"), "node")
    other = displays.join(entities.filter("in_graph"), "canonical").select(canonicalize(F.col("display")).alias("alias"), F.lit(1).alias("pass"), "canonical", "display", "node")
    first = Window.partitionBy("alias").orderBy("pass", "canonical", "display")
    aliases = own.unionByName(other).filter("alias <> ''").withColumn("k", F.row_number().over(first)).filter("k = 1").select("alias", "node")
    names = ids.select(doc_node(F.col("doc_id")).alias("node")).union(mentions.select("node").distinct())
    return KnowledgeGraph(nodes, edges, mentions, entities, aliases, extra is None, names)


def mention_edges(mentions: DataFrame) -> DataFrame:
    """(src, dst, kind, weight, predicates) from documents to their entities."""
    return mentions.select(doc_node(F.col("doc_id")).alias("src"), F.col("node").alias("dst"), F.lit("mentions").alias("kind"), F.lit(1).cast("bigint").alias("weight"), F.lit(None).cast("array<string>").alias("predicates"))


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """(src < dst, kind, weight): entities of one document, by how many documents they share."""
    m = mentions.select("doc_id", "node").distinct()
    names = m.select("node").union(m.select(doc_node(F.col("doc_id")))).distinct()
    pairs = net.cooccurrences(net.incidence(names, m), mentions.sparkSession)
    return pairs.select("src", "dst", F.lit("co_occurs").alias("kind"), "weight")


def build(docs: DataFrame, extractor: Callable[[Column], Column] | None = None, links: DataFrame | Callable[[DataFrame], DataFrame] | None = None, eager: bool = False) -> KnowledgeGraph:
    """The graph of docs(id, text) from capitalised words, or what the extractor finds. eager: the mentions are computed at once, for all tables. links: (mention, canonical), or a function of mentions that gives them, instead of the collapse within documents."""
    mentions = extract_mentions(docs, extractor or rule_extractor())
    mentions = stash(mentions, "mentions") if eager else mentions
    if links is None:
        c = collapse_within(mentions)
        c = stash(c, "collapsed") if eager else c
        # every canonical keeps its own forms; a kept one also gets those of what it absorbed
        displays = c.select("canonical", F.col("mention").alias("display")).union(c.select("kept", "mention")).distinct()
        return _bundle(docs, c.select("doc_id", F.col("kept").alias("canonical")).distinct(), displays, None)
    table = links(mentions) if callable(links) else links
    m = mentions.join(table, "mention", "left").select("doc_id", "mention", F.coalesce("canonical", canonicalize(F.col("mention"))).alias("canonical")).filter("canonical <> ''")
    return _bundle(docs, m.select("doc_id", "canonical").distinct(), m.select("canonical", F.col("mention").alias("display")).distinct(), None)


def call_model(docs: DataFrame, model: Callable[[str], str], cache: DataFrame | None = None, prompt: str = PROMPT) -> DataFrame:
    """docs(id, text): (key, raw) for each text that the cache lacks; failed calls give no row, so that they are tried again."""
    todo = docs.filter(F.length(strip(F.col("text"))) > 0).select(content_key(F.col("text")).alias("key"), fill_prompt(prompt, F.col("text")).alias("prompt")).dropDuplicates(["key"])
    if cache is not None:
        todo = todo.join(cache.select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, p in zip(f["key"], f["prompt"]):
                try:
                    out.append((key, model(p)))
                except Exception:  # noqa: BLE001 - a caller's model may fail in any way
                    continue
            yield pd.DataFrame(out, columns=["key", "raw"])

    return todo.mapInPandas(run, "key string, raw string")


def triples(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, pos, s, p, o) from cached answers(key, raw)."""
    d = docs.select(F.col("id").cast("string").alias("doc_id"), content_key(F.col("text")).alias("key")).join(answers, "key")
    t = d.select("doc_id", F.posexplode(parse_triples(F.col("raw"))).alias("pos", "t"))
    return t.select("doc_id", "pos", "t.s", "t.p", "t.o")


def relations(t: DataFrame) -> DataFrame:
    """(src <= dst, kind, weight, predicates) of canonical triples(doc_id, pos, sc, p, oc)."""
    n = t.select(entity_node(F.col("sc")).alias("a"), entity_node(F.col("oc")).alias("b"), "doc_id", "pos", "p")
    g = n.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").alias("weight"), F.array_sort(F.collect_list(F.struct("doc_id", "pos", "p"))).alias("all"))
    return g.select("src", "dst", F.lit("relates").alias("kind"), "weight", F.array_distinct(F.transform("all", lambda x: x["p"])).alias("predicates"))


def build_from_triples(docs: DataFrame, t: DataFrame, links: DataFrame | None = None) -> KnowledgeGraph:
    """The graph of triples(doc_id, pos, s, p, o); no collapse unless links(mention, canonical) are given."""
    if links is None:
        c = t.withColumn("sc", canonicalize(F.col("s"))).withColumn("oc", canonicalize(F.col("o")))
    else:
        a, b = links.select(F.col("mention").alias("s"), F.col("canonical").alias("sl")), links.select(F.col("mention").alias("o"), F.col("canonical").alias("ol"))
        c = t.join(a, "s", "left").join(b, "o", "left").withColumn("sc", F.coalesce("sl", canonicalize(F.col("s")))).withColumn("oc", F.coalesce("ol", canonicalize(F.col("o"))))
    c = c.filter("sc <> '' and oc <> ''")
    ends = c.select("doc_id", F.explode(F.array(F.struct(F.col("sc").alias("c"), F.col("s").alias("d")), F.struct(F.col("oc").alias("c"), F.col("o").alias("d")))).alias("x"))
    displays = ends.select(F.col("x.c").alias("canonical"), F.col("x.d").alias("display")).distinct()
    return _bundle(docs, ends.select("doc_id", F.col("x.c").alias("canonical")).distinct(), displays, relations(c))


def _grams(d: DataFrame, c: str) -> DataFrame:
    """Rows with `gram`, each run of 1, 2 and 3 characters of a column that is not empty."""
    at = d.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(c))))
    return at.withColumn("gram", F.explode(F.array(*(F.substring(F.col(c), F.col("_at"), F.lit(k)) for k in (1, 2, 3))))).drop("_at")


def resolve(kg: KnowledgeGraph, mentions: DataFrame, allow_substring: bool = True) -> DataFrame:
    """mentions(qid, pos, mention): (qid, pos, mention, node), node null where nothing matches.

    An alias comes first, then an exact canonical, then, for what is left, the
    longest label of the canonicals that contain the mention or lie in it.
    """
    m = mentions.withColumn("c", canonicalize(F.col("mention")))
    m = m.join(kg.aliases.select(F.col("alias").alias("c"), F.col("node").alias("n1")), "c", "left").join(kg.entities.select(F.col("canonical").alias("c"), F.col("node").alias("n2")), "c", "left")
    m = m.withColumn("hit", F.when(F.col("c") != "", F.coalesce("n1", "n2")))
    if not allow_substring:
        return m.select("qid", "pos", "mention", F.col("hit").alias("node"))
    # written, as Spark would else guess that the index of all canonicals, not these few, is small enough to be sent to all tasks
    rest = stash(m.filter("hit is null and c <> ''").select("c").distinct(), "unresolved")
    e = kg.entities.select("canonical", "node", "label").filter("canonical <> ''")
    # what lies in another has its first 3 characters there, or all of them if it has fewer; an index of those finds the candidates
    head = lambda x: F.substring(x, 1, 3)
    inside = rest.select("c", head("c").alias("gram")).join(_grams(e, "canonical"), "gram").filter(F.contains("canonical", "c"))
    around = _grams(rest, "c").join(e.select("*", head("canonical").alias("gram")), "gram").filter(F.contains("c", "canonical"))
    near = inside.select("c", "node", "label").unionByName(around.select("c", "node", "label"))
    best = near.groupBy("c").agg(F.min_by("node", F.struct(-F.length("label"), F.col("node"))).alias("n3"))
    return m.join(best, "c", "left").select("qid", "pos", "mention", F.coalesce("hit", "n3").alias("node"))


def query_mentions(queries: DataFrame, extractor: Callable[[Column], Column]) -> DataFrame:
    """queries(qid, text): (qid, pos, mention), by the labels but with no least length."""
    return extract_mentions(queries.select(F.col("qid").alias("id"), "text"), extractor, min_len=1).withColumnRenamed("doc_id", "qid")
