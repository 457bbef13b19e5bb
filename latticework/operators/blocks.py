"""Exact top-k of cosines between two tables of vectors, block against block.

Each table is written once to the shared folder as blocks, ordered by name. What
Spark shuffles after that are numbers of blocks: a task takes one block of the
left side and a range of blocks of the right side, reads them, and keeps the best
of each row while it goes through the range. Only these leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework import blobs
from latticework.session import scratch_path, ship, unsized

#: Decimals to which similarities are compared, so that equal vectors tie whatever the order of their sums.
DECIMALS = 12
_STRIP = 512  # rows that meet a block at once
_PAIRS = 1 << 16  # pairs that are computed exactly, or leave a task, at once
_HELD = 1 << 26  # bytes of cosines that a task holds


@dataclass(frozen=True)
class Blocks:
    """A folder with a file for each block, of columns k and v, ordered by k within and across files."""

    path: str
    kind: str
    files: int

    @classmethod
    def of(cls, d: DataFrame, key: str, vector: str, rows: int = 4096) -> Blocks:
        """Rows with a vector; of one length all."""
        spark = d.sparkSession
        ship(spark)
        spread = spark.sparkContext.defaultParallelism
        d = d.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
        n = d.count()
        path = scratch_path(spark, "blocks")
        blocks = max(1, -(-n // max(256, min(rows, -(-n // spread)))))
        d.repartitionByRange(blocks, "k").sortWithinPartitions("k").write.parquet(path)
        return cls(path, d.schema["k"].dataType.simpleString(), len(blobs.parts(path)))


def load(file: str) -> tuple[pa.Array, np.ndarray]:
    """Keys and vectors of a block, these of length 1; a zero vector stays."""
    t = blobs.read(file)
    v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1 if len(t) else 0)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return t.column("k").combine_chunks(), v / np.where(n > 0, n, 1.0)


def best_of(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, in order; of equals the first."""
    n = s.shape[1]
    if k < n:
        least = np.partition(s, n - k, axis=1)[:, n - k, None]
        over = s > least
        tie = s == least
        room = k - over.sum(1, keepdims=True)
        some = np.flatnonzero(tie.sum(1) > room[:, 0])
        if len(some):
            tie[some] &= np.cumsum(tie[some], axis=1) <= room[some]
        at = np.nonzero(over | tie)[1].reshape(len(s), k)
    else:
        at = np.broadcast_to(np.arange(n), s.shape)
    order = np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable")
    return np.take_along_axis(at, order, 1)


def _close(u: np.ndarray, v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and cosines of what may reach the least of each row: in single precision for all, exactly for those."""
    s = u.astype(np.float32) @ v.T.astype(np.float32)
    row, col = np.nonzero(s >= (least - _margin(u))[:, None].astype(np.float32))
    sim = np.empty(len(row))
    for i in range(0, len(row), _PAIRS):
        sim[i : i + _PAIRS] = np.einsum("ij,ij->i", u[row[i : i + _PAIRS]], v[col[i : i + _PAIRS]])
    return row, col, np.round(sim, DECIMALS)


def _margin(u: np.ndarray) -> float:
    """By how much a product of unit vectors may be off in single precision."""
    return max(1e-5, 4e-7 * u.shape[1])


def _best(row: np.ndarray, sim: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k greatest of each row, of equals those of the first name, and their ranks; in order of rows."""
    order = np.lexsort((name, -sim, row))
    r = row[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[rank < k], rank[rank < k]


def _search(left: str, right: str, k: int, others_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, theirs = blobs.parts(left), blobs.parts(right)
        for batch in batches:
            for a, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                ids, u = load(mine[a])
                if not len(ids):
                    continue
                most = max(1, min(k, sum(blobs.sizes(theirs[low:high]))))
                best, names = np.full((len(ids), most), -np.inf), np.full((len(ids), most), -1, np.int64)
                held: list[pa.Array] = []
                start = 0
                for b in range(low, high):
                    nbrs, v = load(theirs[b])
                    if not len(nbrs):
                        continue
                    held.append(nbrs)
                    own = pc.fill_null(pc.index_in(ids, value_set=nbrs), -1).to_numpy() if others_only else None
                    for i in range(0, len(ids), _STRIP):
                        x, least = u[i : i + _STRIP], best[i : i + _STRIP, -1].copy()
                        if (least == -np.inf).any() and most + 1 < len(nbrs):  # a bound from this block, one more as a row's own name may be among them
                            s = np.partition(x.astype(np.float32) @ v.T.astype(np.float32), len(nbrs) - most - 1, axis=1)[:, len(nbrs) - most - 1]
                            least = np.maximum(least, s - _margin(u))
                        row, col, sim = _close(x, v, least)
                        if others_only:
                            some = own[i + row] != col
                            row, col, sim = row[some], col[some], sim[some]
                        if not len(row):
                            continue
                        # of equals those of earlier blocks, which come first by name
                        old, at = np.nonzero(best[i : i + _STRIP] > -np.inf)
                        row = np.concatenate([old, row])
                        sim, col = np.concatenate([best[i + old, at], sim]), np.concatenate([names[i + old, at], col + start])
                        kept, rank = _best(row, sim, col, most)
                        best[i + row[kept], rank], names[i + row[kept], rank] = sim[kept], col[kept]
                    start += len(nbrs)
                every = pa.chunked_array(held).combine_chunks() if held else ids.slice(0, 0)
                for i in range(0, len(ids), _STRIP):
                    row, col = np.nonzero(best[i : i + _STRIP] > -np.inf)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + row)), every.take(pa.array(names[i + row, col])), pa.array(best[i + row, col])], ["id", "nbr", "sim"])

    return run


def pairs_above(blocks: Blocks, threshold: float, spark) -> DataFrame:
    """(id, nbr, sim): all pairs of rows, each once, of a cosine of the threshold or more."""
    ship(spark)
    todo = spark.createDataFrame([(a, b) for a in range(blocks.files) for b in range(a, blocks.files)], "a int, b int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = blobs.parts(blocks.path)
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                (ids, u), (nbrs, v) = load(files[a]), load(files[b])
                for i in range(0, len(ids) if len(nbrs) else 0, _STRIP):
                    x = u[i : i + _STRIP]
                    row, col, sim = _close(x, v, np.full(len(x), threshold))
                    some = (sim >= threshold) & ((i + row < col) if a == b else True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + row[some])), nbrs.take(pa.array(col[some])), pa.array(sim[some])], ["id", "nbr", "sim"])

    tasks = 8 * spark.sparkContext.defaultParallelism
    return unsized(todo.repartition(max(1, min(tasks, blocks.files * (blocks.files + 1) // 2))).mapInArrow(run, f"id {blocks.kind}, nbr {blocks.kind}, sim double"))


def shares(left: Blocks, right: Blocks, eps: float, spark) -> DataFrame:
    """(qid, node, cosine, relevance): every pair of rows, with the cosine's place between the least and the greatest of the left row, 0.5 where they hardly differ."""
    ship(spark)
    n = sum(blobs.rows(right.path))
    strip = max(1, min(_STRIP, _HELD // max(1, 8 * n)))
    todo = [(a, i, i + strip) for a, size in enumerate(blobs.rows(left.path)) for i in range(0, size, strip)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, theirs = blobs.parts(left.path), blobs.parts(right.path)
        for batch in batches:
            for a, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                ids, u = load(mine[a])
                ids, u = ids[low:high], u[low:high]
                s, at, names = np.empty((len(u), n)), 0, []
                for f in theirs:
                    nbrs, v = load(f)
                    if len(nbrs):
                        s[:, at : at + len(nbrs)] = u @ v.T
                        at += len(nbrs)
                        names.append(nbrs)
                names = pa.chunked_array(names).combine_chunks() if names else None
                for i in range(len(u) if at else 0):
                    least, most = s[i].min(), s[i].max()
                    x = (s[i] - least) / (most - least) if most - least >= eps else np.full(n, 0.5)
                    for k in range(0, n, _PAIRS):
                        m = min(_PAIRS, n - k)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(m, i))), names.slice(k, m), pa.array(s[i, k : k + m]), pa.array(x[k : k + m])], ["qid", "node", "cosine", "relevance"])

    tasks = 8 * spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame(todo, "a int, low int, high int").repartition(max(1, min(tasks, len(todo))))
    return unsized(rows.mapInArrow(run, f"qid {left.kind}, node {right.kind}, cosine double, relevance double"))


def top_products(left: Blocks, right: Blocks, k: int, spark, others_only: bool = False) -> DataFrame:
    """(id, nbr, sim, rank from 1): the k greatest cosines for each key of left, ties by that of right.

    others_only: a row is not compared with the one of its own name.
    """
    ship(spark)
    busy = 2 * spark.sparkContext.defaultParallelism
    ranges = max(1, min(right.files, -(-busy // max(1, left.files))))
    ends = [right.files * i // ranges for i in range(ranges + 1)]
    rows = [(a, low, high) for a in range(left.files) for low, high in zip(ends, ends[1:])] if right.files else []
    pairs = spark.createDataFrame(rows, "a int, low int, high int").repartition(max(1, min(len(rows), 2 * busy)), "a", "low")
    found = pairs.mapInArrow(_search(left.path, right.path, k, others_only), f"id {left.kind}, nbr {right.kind}, sim double")
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
