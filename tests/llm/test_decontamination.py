"""Recall of decontamination over benchmarks that are larger, and items that are longer, than the given ones."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from latticework.llm import decontamination


def corpus(n_docs, length, seed):
    """Texts of invented words, frequent and rare ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(20_000)]
    weights = [1 / (k + 20) for k in range(len(vocabulary))]
    return [rng.choices(vocabulary, weights, k=length) for _ in range(n_docs)]


def found(spark, texts, items):
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, (_, t) in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    return sum((d, k) in got for k, (d, _) in enumerate(items)) / len(items)


@pytest.mark.parametrize("changed,least", [(0.0, 0.99), (0.15, 0.95)])
def test_recall_of_several_thousand_items(spark, changed, least):
    texts, rng, items = corpus(600, 400, 5), random.Random(6), []
    for k in range(4000):
        d, n = k % len(texts), rng.randrange(15, 60)
        at = rng.randrange(len(texts[d]) - n)
        items.append((d, [x if rng.random() >= changed else f"other{rng.randrange(9999)}" for x in texts[d][at : at + n]]))
    # an item of which fewer words are left than the threshold of a paraphrase asks for is no match
    same = lambda d, t: decontamination.lcs(decontamination.place_masks(t), len(t), texts[d]) / len(t)
    assert found(spark, texts, [(d, t) for d, t in items if same(d, t) >= 0.8]) >= least


def test_recall_without_the_rarest_words(spark):
    """The rarest quarter of each item's words is replaced; the answer check needs the last sentence, which here is the whole."""
    texts, rng, items = corpus(400, 300, 9), random.Random(10), []
    count = Counter(x for t in texts for x in t)
    for k in range(400):
        at, n = rng.randrange(200), rng.randrange(24, 60)
        t = texts[k][at : at + n]
        rare = set(sorted(range(n), key=lambda j: count[t[j]])[: n // 4])
        items.append((k, [f"other{rng.randrange(9999)}" if j in rare else x for j, x in enumerate(t)]))
    assert found(spark, texts, items) >= 0.95


def split(text):
    return [w for w in re.split(r"[\x00-/:-`{-\x7f]+", (text or "").lower()) if w]


def brute(docs, items, size=48):
    """Every passage against every item, without terms, files or a latent space."""
    out = set()
    for doc, text in docs:
        w = split(text)
        for item, q in items:
            x = split(q)
            body = q.rstrip().rstrip(".!?。！？") if q else ""
            last = split(re.split(r"[.!?] |[.!?]?\n|。", body)[-1])
            for k in range(1 + max(0, -(-(len(w) - size) // (size // 2))) if w and x else 0):
                a = k * (size // 2)
                near = w[max(0, a - len(x)) : a + size + len(x)]
                share = decontamination.lcs(decontamination.place_masks(x), len(x), near) / len(x)
                answer = decontamination.lcs(decontamination.place_masks(last), len(last), near) / len(last) if last else 1
                if share >= 0.8 or (share >= 0.6 and answer >= 0.6):
                    out.add((doc, item))
                    break
    return out


def test_query_equals_brute_force(spark, sf):
    """The tables, and beside them paraphrases, a null id, repeated rows and empty texts on both sides."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = random.Random(3)
    for k, (_, q) in enumerate(items[:20]):
        soft = " ".join(x if rng.random() > 0.2 else f"new{rng.randrange(99)}" for x in q.split())
        docs.append((9000 + k, f"{docs[k][1]} {soft} {docs[k + 1][1]}"))
    docs += [(None, items[3][1]), (9100, items[4][1]), (9100, items[4][1]), (9101, ""), (9102, None)]
    items += [(None, items[5][1]), (900, ""), (901, None), (items[6][0], items[6][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.matches(d, b).collect()
    got, want = {(r.doc_id, r.item_id) for r in rows}, brute(docs, items)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 20
    assert sum(r.doc_id == 9100 and r.item_id == items[4][0] for r in rows) == 2 and any(r.doc_id is None for r in rows)


def test_item_rows_cover_long_items():
    item, first, end = decontamination.item_rows(np.array([0, 20, 68, 168]), 48)
    assert list(zip(item.tolist(), first.tolist(), end.tolist())) == [(0, 0, 20), (1, 20, 68), (2, 68, 168), (2, 68, 116), (2, 92, 140), (2, 116, 164), (2, 140, 168)]


def test_recall_of_long_items(spark):
    texts, rng, items = corpus(60, 1200, 7), random.Random(8), []
    for d in range(len(texts)):
        at = rng.randrange(500)
        items.append((d, [x if rng.random() >= 0.15 else f"other{rng.randrange(9999)}" for x in texts[d][at : at + 700]]))
    assert found(spark, texts, items) == 1
