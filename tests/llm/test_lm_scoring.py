"""One part of LM scoring, counted, added up and scored without Spark: its memory, and its numbers against plain Python."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from latticework.llm import lm_scoring
from latticework.llm._files import write_file

SHARDS, K = 256, 4.0


@pytest.fixture(scope="module")
def texts():
    """Some 6 MB: short texts, a long one and one without words, whose bigrams are nearly all different."""
    draw = np.random.default_rng(4)
    sizes = [*draw.integers(1, 2000, 700).tolist(), 300_000, 0, *draw.integers(1, 300, 50).tolist()]
    return [" ".join(f"w{i}" for i in draw.integers(0, 30_000, n).tolist()) for n in sizes]


def run(texts, good, path):
    write_file(path, pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    part = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([path]), pa.array([good], pa.list_(pa.int64()))], ["part", "path", "goods"])
    peaks = []

    def traced(f):
        tracemalloc.start()
        try:
            out = f()
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
        return out

    counts = traced(lambda: pa.Table.from_batches(list(lm_scoring._count(SHARDS)(iter([part])))))
    total = lm_scoring._total(SHARDS)
    totals = pa.concat_tables([total(counts.filter(pc.equal(counts["shard"], s))) for s in pc.unique(counts["shard"])])
    sums = [pc.sum(totals[c]).as_py() for c in ("vocabulary", "all_n", "all_g")]
    return traced(lambda: lm_scoring._score(K, *sums)(totals, pa.Table.from_batches([part]))), peaks


def plain(texts, good, docs):
    words = [t.split() for t in texts]
    pairs = [list(zip(["", *w[:-1]], w)) for w in words]

    def model(of):
        return [Counter(x for i in of for x in each(pairs[i])) for each in (lambda p: [c for _, c in p], lambda p: [b for b, _ in p], list)]

    every, target = model(range(len(texts))), model(good)
    size, sizes = sum(every[0].values()), sum(target[0].values())
    scale, vocabulary = sizes / size, len(every[0])
    for d in docs:
        if not words[d]:
            yield d, None, None
            continue
        own, means = model([d]), []
        for counts, factor, n, has in ((target, 1, sizes, d in good), (every, scale, size, True)):
            at = lambda i, x: factor * (counts[i][x] - has * own[i][x])
            p = lambda c: (at(0, c) + 1) / (factor * (n - has * len(words[d])) + vocabulary)
            means.append(sum(-math.log((at(2, (b, c)) + K * p(c)) / (at(1, b) + K)) for b, c in pairs[d]) / len(words[d]))
        yield d, *means


def test_a_part_in_little_memory(texts, tmp_path):
    good = list(range(0, len(texts), 3))
    run(texts[:5], [0], f"{tmp_path}/first.parquet")  # tables of powers are made once in a worker
    scored, (counting, scoring) = run(texts, good, f"{tmp_path}/part.parquet")
    size = sum(map(len, texts))
    assert size > 6_000_000
    assert counting < 15 * size and scoring < 18 * size
    rows = scored.to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(len(texts))) and [r["n_tokens"] for r in rows] == [len(t.split()) for t in texts]
    for d, target, background in plain(texts, set(good), [0, 1, 2, 350, 351, 699, 700, 701, 702, 751]):
        got = rows[d]["loss_target"], rows[d]["loss_background"]
        assert got == (None, None) if target is None else np.allclose(got, (target, background), rtol=0, atol=1e-9), d
