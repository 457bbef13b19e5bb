"""Operator 5, benchmark decontamination by latent semantic retrieval.

1. Terms are all words of the benchmark, frequent ones too. One pass over the
   texts writes, to files of the shared folder, the places of the terms in each
   document (other words match nothing and only widen the gaps), and counts, over
   all passages of the corpus (runs of `size` words, without overlap), the
   passages of each term.
2. An item that is longer than a passage is also cut into passages of the same
   size, with overlaps of half of it; each is a row that stands for the item.
   The rows of the items are taken in blocks of `block_rows`, so that `rank` dimensions are
   enough for each however large the benchmark is. For each block, randomised
   SVD of the TF-IDF matrix A whose rows are the passages of the corpus and the
   items' rows, over the block's terms, the latter weighted so that both halves have
   the same energy: every task adds up its rows' share of K W, K being A'A and
   W an orthonormal random matrix; the sum over the tasks gives, by the Nystroem
   method, the right singular vectors U of A.
3. Every passage, now with overlaps of half its size, and every row of an item are
   projected by the U of each block and normalised there. Pairs of which the
   cosine reaches `min_cosine` are candidates, the passage and the whole item.
4. For each candidate the longest common subsequence of words is taken between
   the item and the passage widened by the item's length at both ends. A document is
   contaminated by an item if the share of the item's words in it reaches
   `verbatim`; or if it reaches `paraphrase` and the answer check holds, that is,
   the same share of the words of the item's last sentence is in it as well.

The texts are read once, the files of places once for each block and once for
the search. Nothing is shuffled but term counts and the tasks' sums, whose size
depends on the benchmark. A block's `frequent` most frequent terms are columns of
a dense matrix in each task, the others are sparse. The benchmark itself is held
by every task; it must have no more than `most_terms` different words.

Recall of paraphrases, against the same verdicts without the cosine search: the
tests ask for 0.95, with every seventh word replaced, and with the rarest quarter
of the words replaced.

Defined results: documents and items without words (null, empty) match nothing.
Null ids are results like others. Repeated documents are each judged on their
own, repeated items each reported. Texts of any length are searched whole; one
shorter than a passage is one passage. An empty table on either side gives an
empty result. Other columns are not read by `matches` and kept by `apply`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm._arrow import ragged, slices, split_words
from latticework.llm._files import load_array, read_file, save_array, write_file
from latticework.session import scratch_path, ship, stash

_OUT = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, verdict string"
_BLOCK = 64  # terms in a row of partial sums
_GROUP = 64  # parts that are added up at once
_LAYERS = 24  # entries of a sparse row that are added one after the other


@dataclass
class Places:
    """Where the terms are in some documents."""

    n_words: np.ndarray  # of each document
    at: np.ndarray  # n + 1 offsets into spot and term
    spot: np.ndarray  # the number of the word in its document
    term: np.ndarray

    def passages(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The passage, without overlaps, of each place, numbered over all documents, and how many there are of each document."""
        count = -(-self.n_words // size)
        return np.repeat(np.cumsum(count) - count, np.diff(self.at)) + self.spot // size, count

    def overlapping(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages that overlap by half: the passage and the term of each place, twice where it lies in two, and how many there are of each document."""
        step = size // 2
        count = np.where(self.n_words > 0, 1 + -(-np.maximum(self.n_words - size, 0) // step), 0)
        start, most = np.repeat(np.cumsum(count) - count, np.diff(self.at)), np.repeat(count, np.diff(self.at))
        k = self.spot // step
        here = [(k - back >= 0) & (k - back < most) & (self.spot < (k - back) * step + size) for back in (0, 1)]
        return np.concatenate([(start + k - back)[x] for back, x in zip((0, 1), here)]), np.concatenate([self.term[x] for x in here]), count


def item_rows(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first and end word of the rows of each: the whole, and its passages where it is longer than one."""
    n = np.diff(at)
    count = np.where(n > size, 2 + -(-np.maximum(n - size, 0) // (size // 2)), 1)
    item, k = np.repeat(np.arange(len(n)), count), ragged(count)
    first = at[item] + np.maximum(k - 1, 0) * (size // 2)
    return item, first, np.where(k > 0, np.minimum(first + size, at[item + 1]), at[item + 1])


def _add_rows(out: np.ndarray, to: np.ndarray, m: np.ndarray, of: np.ndarray, x: np.ndarray) -> None:
    """out[to] += x m[of], for ascending `to`: first the first of each row, then the second, and so on, long rows as sums."""
    if not len(to):
        return
    head = np.flatnonzero(np.diff(to, prepend=-1))
    size = np.diff(np.append(head, len(to)))
    for k in range(_LAYERS):
        at = head[size > k] + k
        if not len(at):
            return
        out[to[at]] += m[of[at]] * x[at][:, None]
    for h, n in zip(head[size > _LAYERS].tolist(), size[size > _LAYERS].tolist()):
        at = slice(h + _LAYERS, h + n)
        out[to[h]] += x[at] @ m[of[at]]


class Matrix:
    """TF-IDF rows of unit length: the frequent terms, which have the first numbers, as a dense part, the others as a sparse one."""

    def __init__(self, row: np.ndarray, term: np.ndarray, rows: int, idf: np.ndarray, frequent: int) -> None:
        frequent = min(frequent, len(idf))
        many = term < frequent
        n = np.bincount(row[many] * frequent + term[many], minlength=rows * frequent).reshape(rows, frequent).astype(np.float32) if frequent else np.zeros((rows, 0), np.float32)
        some = n > 0
        n[some] = 1 + np.log(n[some])
        self.dense = n * idf[:frequent].astype(np.float32)
        key, count = np.unique(row[~many] * len(idf) + term[~many], return_counts=True)
        self.row, self.term = key // max(len(idf), 1), key % max(len(idf), 1)
        x = ((1 + np.log(count)) * idf[self.term]).astype(np.float32)
        square = np.einsum("ij,ij->i", self.dense, self.dense) + np.bincount(self.row, weights=x * x, minlength=rows)
        self.used = square > 0
        scale = (1 / np.sqrt(np.where(self.used, square, 1))).astype(np.float32)
        self.dense *= scale[:, None]
        self.x = x * scale[self.row]
        self.frequent = frequent

    def times(self, m: np.ndarray) -> np.ndarray:
        out = self.dense @ m[: self.frequent]
        _add_rows(out, self.row, m, self.term, self.x)
        return out

    def turned_times(self, y: np.ndarray, total: np.ndarray) -> None:
        """Add the product of the transposed matrix with y to total."""
        total[: self.frequent] += self.dense.T @ y
        o = np.argsort(self.term, kind="stable")
        _add_rows(total, self.term[o], y, self.row[o], self.x[o])


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Longest common subsequence; masks: for each word of the one side the bits of its places."""
    full = (1 << length) - 1
    s = full
    for x in words:
        m = masks.get(x)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return length - s.bit_count()


def place_masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | 1 << i
    return out


class Items:
    """The benchmark: words as numbers of terms, masks for the LCS, and last sentences."""

    def __init__(self, ids: list[int | None], texts: list[str | None], terms: np.ndarray) -> None:
        w = split_words(pa.array(texts, pa.string()))
        h = np.searchsorted(terms, w.hashes())
        some = np.flatnonzero(np.diff(w.at) > 0)
        self.ids = [ids[i] for i in some]
        self.words = [h[w.at[i] : w.at[i + 1]] for i in some]
        self.masks = [place_masks(x.tolist()) for x in self.words]
        last = []
        for i in some:
            t = texts[i].rstrip().rstrip(".!?。！？")
            cut = max(t.rfind(x) for x in (". ", "! ", "? ", ".\n", "!\n", "?\n", "\n", "。"))
            last.append(t[cut + 1 :])
        a = split_words(pa.array(last, pa.string()))
        ah = np.searchsorted(terms, a.hashes())
        self.answers = [ah[a.at[k] : a.at[k + 1]].tolist() for k in range(len(last))]
        self.answer_masks = [place_masks(x) for x in self.answers]


def _spool(path: str, terms: np.ndarray, size: int, most: int = 12_000_000):
    """Write the places of the terms in files; (path, term, n, total), the passages that hold each term and all passages, for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        df, bytes_, total = np.zeros(len(terms), np.int64), 0, 0

        def close() -> pa.RecordBatch:
            nonlocal bytes_, total
            file = f"{path}/{uuid.uuid4().hex}.parquet"
            write_file(file, pa.Table.from_batches(held))
            some = np.flatnonzero(df)
            out = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([some], pa.list_(pa.int64())), pa.array([df[some]], pa.list_(pa.int64())), pa.array([total])], ["path", "term", "n", "total"])
            held.clear()
            df[:] = 0
            bytes_ = total = 0
            return out

        for b in slices(batches, "text"):
            w = split_words(b.column("text"))
            h = w.hashes()
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            found = np.flatnonzero(terms[at] == h)
            ends = np.searchsorted(found, w.at)
            p = Places(np.diff(w.at), ends, found - np.repeat(w.at[:-1], np.diff(ends)), at[found])
            row, count = p.passages(size)
            df += np.bincount(np.unique(row * len(terms) + p.term) % len(terms), minlength=len(terms))
            total += int(count.sum())
            offsets = pa.array(ends.astype(np.int32))
            cols = [b.column("doc_id"), pa.array(p.n_words.astype(np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (p.spot, p.term))]
            held.append(pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "spot", "term"]))
            bytes_ += b.column("text").nbytes
            if bytes_ >= most:
                yield close()
        if held:
            yield close()

    return run


def _places(file: str, words: int = 100_000) -> Iterator[tuple[pa.Array, Places]]:
    """Some documents of a file at a time: their ids and places."""
    for b in read_file(file).combine_chunks().to_batches():
        upto = np.cumsum(np.asarray(b.column("n_words")).astype(np.int64)) // words
        cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:]):
            part = b.slice(i, j - i)
            size = np.asarray(part.column("spot").value_lengths()).astype(np.int64)
            lists = [part.column(c).flatten().to_numpy().astype(np.int64) for c in ("spot", "term")]
            yield part.column("doc_id"), Places(np.asarray(part.column("n_words")).astype(np.int64), np.concatenate([[0], np.cumsum(size)]), *lists)


def _sketch(path: str, size: int, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, idf, omega = (np.asarray(load_array(f"{path}/{x}.npy")) for x in ("to", "idf", "omega"))
        total, rows = np.zeros(omega.shape, np.float64), 0
        for batch in batches:
            for file in batch.column("path").to_pylist():
                for _, p in _places(file):
                    row, count = p.passages(size)
                    mine = to[p.term] >= 0
                    m = Matrix(row[mine], to[p.term[mine]], int(count.sum()), idf, frequent)
                    rows += int(m.used.sum())
                    m.turned_times(m.times(omega), total)
        group = TaskContext.get().partitionId() // _GROUP
        for k in range(0, len(idf), _BLOCK):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // _BLOCK]), pa.array([group]), pa.array([rows if k == 0 else 0]), pa.array([total[k : k + _BLOCK].tobytes()], pa.binary())], ["block", "part", "rows", "sums"]
            )

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the same block and part; what is left is a part of the next round."""
    sums: dict[tuple[int, int], list] = {}
    for b in batches:
        for k, part, rows, x in zip(*(c.to_pylist() for c in b.columns)):
            s = sums.setdefault((k, part), [0, 0.0])
            s[0] += rows
            s[1] = s[1] + np.frombuffer(x, np.float64)
    for (k, part), s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part // _GROUP]), pa.array([s[0]]), pa.array([s[1].tobytes()], pa.binary())], ["block", "part", "rows", "sums"])


def right_vectors(g: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Eigenvectors of K from g = K omega, by the Nystroem method."""
    shift = np.sqrt(len(g)) * np.finfo(np.float32).eps * max(np.linalg.norm(g), 1e-12)
    y = g + shift * omega
    c = omega.T @ y
    lam, v = np.linalg.eigh((c + c.T) / 2)
    keep = lam > shift * 1e-3
    u, s, _ = np.linalg.svd(y @ (v[:, keep] / np.sqrt(lam[keep])), full_matrices=False)
    return u[:, : min(rank, int((s > 0).sum()))]


def _candidates(blocks: list, row: np.ndarray, term: np.ndarray, rows: int, min_cosine: float, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, items and the cosines of the two in the latent space of a block, ordered by item."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for to, idf, u, latent, item in blocks:
        local = to[term]
        mine = local >= 0
        m = Matrix(row[mine], local[mine], rows, idf, frequent)
        used = np.flatnonzero(m.used)
        y = m.times(u)[used]
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
        for k in range(0, len(used), 8192):
            cosine = y[k : k + 8192] @ latent
            p, i = np.divmod(np.flatnonzero(cosine >= min_cosine), cosine.shape[1])
            found.append((used[k + p], item[i], cosine[p, i]))
    p, i, c = (np.concatenate(x) for x in zip(*found))
    o = np.lexsort((-c, p, i))  # of several rows of an item the nearest
    p, i, c = p[o], i[o], c[o]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 0) | (np.diff(i) != 0)
    return p[new], i[new], c[new]


def _search(path: str, n_blocks: int, terms: np.ndarray, ids: list, texts: list, size: int, min_cosine: float, verbatim: float, paraphrase: float, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [tuple(np.asarray(load_array(f"{path}/{k}/{x}.npy")) for x in ("to", "idf", "u", "latent", "item")) for k in range(n_blocks)]
        items = Items(ids, texts, terms)
        length = np.array([len(x) for x in items.words])
        of_item = np.zeros(len(terms), bool)
        for batch in batches:
            for file in batch.column("path").to_pylist():
                for doc, p in _places(file):
                    row, term, count = p.overlapping(size)
                    text_of = np.repeat(np.arange(len(count)), count)
                    first = ragged(count) * (size // 2)
                    q, item, cosine = _candidates(blocks, row, term, len(text_of), min_cosine, frequent)
                    t, n = text_of[q], length[item]
                    # places of the widened passages
                    key = np.repeat(np.arange(len(doc)), np.diff(p.at)) << 32 | p.spot
                    low = np.searchsorted(key, t << 32 | np.maximum(first[q] - n, 0))
                    high = np.searchsorted(key, t << 32 | (first[q] + size + n))
                    best: dict[tuple[int, int], tuple] = {}
                    last = -1
                    for t, i, n, low, high, c in zip(t.tolist(), item.tolist(), n.tolist(), low.tolist(), high.tolist(), cosine.tolist()):  # noqa: B020, PLW2901
                        if i != last:
                            if last >= 0:
                                of_item[items.words[last]] = False
                            of_item[items.words[i]] = True
                            last = i
                        near = p.term[low:high]
                        near = near[of_item[near]]  # no other word can be in the common subsequence
                        if len(near) < paraphrase * n:
                            continue
                        near = near.tolist()
                        share = lcs(items.masks[i], n, near) / n
                        if share < paraphrase:
                            continue
                        ans = lcs(items.answer_masks[i], len(items.answers[i]), near) / len(items.answers[i]) if items.answers[i] else 1.0
                        if share >= verbatim or ans >= paraphrase:
                            one = (share, ans, c)
                            if (t, i) not in best or one > best[t, i]:
                                best[t, i] = one
                    if last >= 0:
                        of_item[items.words[last]] = False
                    keys = sorted(best)
                    got = [best[x] for x in keys]
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc.take(pa.array([t for t, _ in keys], pa.int64())),
                            pa.array([items.ids[i] for _, i in keys], pa.int64()),
                            *(pa.array([round(x[j], 6) for x in got], pa.float64()) for j in (2, 0, 1)),
                            pa.array(["verbatim" if x[0] >= verbatim else "paraphrase" for x in got], pa.string()),
                        ],
                        ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "verdict"],
                    )

    return run


def _fit(files: DataFrame, tasks: int, path: str, df: np.ndarray, idf: np.ndarray, words: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray, size: int, rank: int, seed: int, frequent: int) -> None:
    """Save a block: its terms, frequent ones first, their right singular vectors, the latent rows words[first:end] and the item of each."""
    n = end - first
    row, term = np.repeat(np.arange(len(item)), n), words[np.repeat(first, n) + ragged(n)]
    own = np.unique(term)
    own = own[np.argsort(-df[own], kind="stable")]
    to = np.full(len(df), -1)
    to[own] = np.arange(len(own))
    width = min(rank + 16, len(own))
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(own), width)))[0]
    for name, x in (("to", to), ("item", item), ("idf", idf[own]), ("omega", omega.astype(np.float32))):
        save_array(f"{path}/{name}.npy", x)
    kind = "block long, part long, rows long, sums binary"
    sums = files.repartition(tasks, "path").mapInArrow(_sketch(path, size, frequent), kind)
    parts = tasks
    while parts > 1:  # a tree, so that no task adds up more than _GROUP parts of a block
        parts = -(-parts // _GROUP)
        sums = sums.repartition("block", "part").mapInArrow(_add, kind)
    sums = stash(sums, "sketch").orderBy("block").collect()  # a row for each block of terms
    g = np.concatenate([np.frombuffer(x.sums, np.float64) for x in sums]).reshape(len(own), width) if sums else np.zeros((len(own), width))
    # the items' rows, of the same energy as all passages together
    m = Matrix(row, to[term], len(item), idf[own], frequent)
    weight = max(1.0, sum(r.rows for r in sums) / len(item))
    mine = np.zeros((len(own), width))
    m.turned_times(m.times(omega), mine)
    u = np.ascontiguousarray(right_vectors(g + weight * mine, omega, rank), np.float32)
    latent = m.times(u)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    save_array(f"{path}/u.npy", u)
    save_array(f"{path}/latent.npy", np.ascontiguousarray(latent.T, np.float32))


def matches(
    docs: DataFrame, benchmark: DataFrame, size: int = 48, rank: int = 256, block_rows: int = 512, frequent: int = 512, min_cosine: float = 0.3,
    verbatim: float = 0.8, paraphrase: float = 0.6, most_terms: int = 1_000_000, seed: int = 11,
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, verdict): every contaminated document with each item that it holds."""
    spark = docs.sparkSession
    ship(spark)
    table = benchmark.select(F.col("item_id").cast("bigint"), "text").orderBy("item_id", "text").toPandas()
    ids = [None if x != x or x is None else int(x) for x in table["item_id"].tolist()]
    texts = [x if isinstance(x, str) else None for x in table["text"].tolist()]
    terms = np.unique(split_words(pa.array(texts, pa.string())).hashes())
    items = Items(ids, texts, terms)
    if not items.ids:
        return spark.createDataFrame([], _OUT)
    if len(terms) > most_terms:
        raise ValueError(f"the benchmark has {len(terms)} different words; most_terms is {most_terms}")
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    path = scratch_path(spark, "latent")
    files = stash(d.mapInArrow(_spool(f"{path}/places", terms, size), "path string, term array<long>, n array<long>, total long"), "places")
    counted = files.select(F.explode(F.arrays_zip("term", "n")).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n")).collect()  # a row for each term of the benchmark
    total, n_files = files.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    df = np.zeros(len(terms))
    for t, n in counted:
        df[t] = n
    idf = np.log((total + 1) / (df + 1)) + 1e-3
    files = files.select("path")
    tasks = max(1, min(n_files, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    at = np.concatenate([[0], np.cumsum([len(x) for x in items.words])])
    words = np.concatenate(items.words)
    item, first, end = item_rows(at, size)
    n_blocks = -(-len(item) // block_rows)
    for k in range(n_blocks):
        b = slice(k * len(item) // n_blocks, (k + 1) * len(item) // n_blocks)
        _fit(files, tasks, f"{path}/{k}", df, idf, words, item[b], first[b], end[b], size, rank, seed + k, frequent)
    return files.repartition(tasks, "path").mapInArrow(_search(path, n_blocks, terms, ids, texts, size, min_cosine, verbatim, paraphrase, frequent), _OUT)


def apply(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Documents that hold no item. Documents with a null doc_id stay."""
    gone = stash(matches(docs, benchmark, **how).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


__all__ = ["Items", "apply", "lcs", "matches"]
