"""Operator 3, SimHash near-duplicates by tiled exact comparison.

Each document gets 128 bits: the signs of the sums, over its words, of +1 or -1
by the bits of the word's hash. A word counts once in a document, with a weight
that grows with its length, so that function words count little. Documents with equal bits are grouped first. The others are
ordered by population count, cut into strips, and every strip is compared with
every other by exclusive-or and bit counts, tile by tile. Two tiles, or strips,
whose population counts differ by more than the radius can hold no pair and are
skipped; nothing else is, so all pairs within the radius are found. The
documents of a connected component form a group, of which the smallest doc_id
stays. A document is named by doc_id and text: different texts of one doc_id are
different documents, and of those in a group the one with the smaller text hash
comes first.

Defined results: texts without a word (null, empty, symbols alone) and rows with
a null doc_id take no part and stay. Rows that repeat doc_id and text are one
document; `apply` leaves one of them, the first as JSON. Ties of a bit's sum count as 0. Documents
of any length are hashed whole. An empty table gives an empty result. Other
columns are not read by `removed` and kept by `apply`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm._arrow import mix, slices, split_words
from latticework.llm._files import read_table
from latticework.llm._graph import components, local_forest
from latticework.session import scratch_path, ship, stash

_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2) - 1
_OTHER = np.uint64(0x5851F42D4C957F2D)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) 64-bit words, and the number of words of each text."""
    w = split_words(texts)
    n = len(texts)
    h = w.hashes()
    owner = w.owner()
    with np.errstate(over="ignore"):
        once = np.unique(mix(h + owner.astype(np.uint64) * _OTHER), return_index=True)[1]
    h, row = h[once], owner[once] * 256
    weight = np.maximum(2 * (np.minimum(w.end[once] - w.start[once], 12) - 3), 0) + 1.0
    sums = []
    for half in (h, mix(h ^ _OTHER)):
        parts = half.view(np.uint8).reshape(-1, 8)
        sums += [np.bincount(row + parts[:, k], weights=weight, minlength=n * 256).reshape(n, 256) @ _SIGNS for k in range(8)]
    bits = np.packbits(np.concatenate(sums, axis=1) > 0, axis=1) if n else np.zeros((0, 16), np.uint8)
    return np.ascontiguousarray(bits).view(np.uint64), np.diff(w.at)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        bits, words = fingerprints(b.column("text"))
        bits = bits.view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(bits[:, 0]), pa.array(bits[:, 1])], ["doc_id", "text_key", "h0", "h1"]).filter(pa.array(words > 0))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool, rows: int = 32, columns: int = 4096) -> tuple[np.ndarray, np.ndarray, int]:
    """Indices of all pairs of a and b, (n, 2) words ordered by population count, within the radius; and the number of tiles skipped.

    same: a is b, and each pair is wanted once.
    """
    pa_, pb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    a0, a1, b0, b1 = (np.ascontiguousarray(x) for x in (a[:, 0], a[:, 1], b[:, 0], b[:, 1]))
    wide, count, more = np.empty((rows, columns), np.uint64), np.empty((rows, columns), np.uint8), np.empty((rows, columns), np.uint8)
    left, right, skipped = [], [], 0
    for j in range(0, len(b), columns):
        m = min(columns, len(b) - j)
        c0, c1, low, high = b0[None, j : j + m], b1[None, j : j + m], pb[j], pb[j + m - 1]
        for i in range(0, min(len(a), j + m) if same else len(a), rows):
            n = min(rows, len(a) - i)
            if pa_[i] - high > radius or low - pa_[i + n - 1] > radius:
                skipped += 1
                continue
            x, y, z = wide[:n, :m], count[:n, :m], more[:n, :m]
            np.bitwise_xor(a0[i : i + n, None], c0, out=x)
            np.bitwise_count(x, out=y)
            np.bitwise_xor(a1[i : i + n, None], c1, out=x)
            np.bitwise_count(x, out=z)
            y += z
            hit = y <= radius
            if hit.any():
                p, q = np.nonzero(hit)
                p, q = p + i, q + j
                if same:
                    p, q = p[p < q], q[p < q]
                left.append(p)
                right.append(q)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right), skipped) if left else (none, none, skipped)


def _compare(path: str, radius: int):
    def strip(k: int) -> tuple[np.ndarray, np.ndarray]:
        t = read_table(f"{path}/strip={k}")
        h = np.stack([t.column(c).to_numpy() for c in ("h0", "h1")], axis=1).view(np.uint64) if len(t) else np.zeros((0, 2), np.uint64)
        order = np.argsort(np.bitwise_count(h).sum(1, dtype=np.int64), kind="stable")
        return h[order], t.column("node").to_numpy()[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                if last[0] != x:
                    last = (x, strip(x))
                (a, ra), (b, rb) = last[1], last[1] if x == y else strip(y)
                p, q, _ = close_pairs(a, b, radius, x == y)
                if len(p):
                    u, v = local_forest(ra[p], rb[q])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return run


def removed(docs: DataFrame, radius: int = 22, strip_rows: int = 16384) -> DataFrame:
    """(doc_id, kept_id) of every document that is a copy or near copy of one that stays."""
    return _removed(_signed(docs), radius, strip_rows).select("doc_id", "kept_id").distinct()


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, h0, h1) of each document: doc_id and text name it."""
    ship(docs.sparkSession)
    d = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return stash(d.mapInArrow(_sign, "doc_id long, text_key long, h0 long, h1 long"), "simhash")


def _removed(signed: DataFrame, radius: int, strip_rows: int) -> DataFrame:
    """(doc_id, text_key, kept_id), a row for each row of `signed` whose document goes."""
    spark = signed.sparkSession
    # the first document of each fingerprint; grouping adds up within tasks first, so that no group meets in one
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    reps = stash(signed.groupBy("h0", "h1").agg(first).withColumn("node", F.xxhash64("h0", "h1")), "simhash-reps")
    pop = F.bit_count("h0") + F.bit_count("h1")
    strips = max(1, -(-reps.count() // strip_rows))
    path = scratch_path(spark, "simhash-strips")
    ranged = reps.select("node", "h0", "h1", pop.alias("pop")).repartitionByRange(strips, "pop", "h0", "h1").withColumn("strip", F.spark_partition_id())
    ranged.write.partitionBy("strip").parquet(path)
    made = spark.read.schema("node long, h0 long, h1 long, pop int, strip int").parquet(path)
    ends = stash(made.groupBy("strip").agg(F.min("pop").alias("low"), F.max("pop").alias("high")), "simhash-ends")
    x, y = ends.select(F.col("strip").alias("x"), F.col("high").alias("x_high")), ends.select(F.col("strip").alias("y"), F.col("low").alias("y_low"))
    pairs = x.join(y, (F.col("x") <= F.col("y")) & (F.col("y_low") - F.col("x_high") <= radius)).select("x", "y")
    tasks = max(1, min(strips * (strips + 1) // 2, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    edges = pairs.repartition(tasks, "x", "y").sortWithinPartitions("x", "y").mapInArrow(_compare(path, radius), "a long, b long")
    label = components(edges)
    grouped = reps.join(label, "node", "left").select("h0", "h1", "first", F.coalesce("label", "node").alias("label"))
    kept = grouped.groupBy("label").agg(F.min("first").alias("kept"))
    # a frequent fingerprint's rows are split by the adaptive skew join
    of = stash(grouped.join(kept, "label").select("h0", "h1", "kept"), "simhash-kept")
    return signed.join(of, ["h0", "h1"]).filter(F.struct("doc_id", "text_key") != F.col("kept")).select("doc_id", "text_key", F.col("kept")["doc_id"].alias("kept_id"))


def apply(docs: DataFrame, radius: int = 22, strip_rows: int = 16384, broadcast_limit: int = 500_000) -> DataFrame:
    """Documents without the copies; one document of each group stays.

    Up to broadcast_limit names of documents that go (8 MB) are sent to the
    documents; with more of them, both are shuffled.
    """
    names = docs.columns
    signed = _signed(docs)
    gone = stash(_removed(signed, radius, strip_rows).select("doc_id", "text_key").distinct(), "simhash-gone")
    again = stash(signed.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"), "simhash-again")
    row = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"))
    left = row.join(F.broadcast(gone) if gone.count() <= broadcast_limit else gone, ["doc_id", "text_key"], "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    again = F.broadcast(again) if again.count() <= broadcast_limit else again
    once = left.join(again, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(again, ["doc_id", "text_key"], "left_anti").select("row.*").unionByName(once.select("row.*"))
