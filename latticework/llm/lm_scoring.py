"""Operator 4, LM scoring by cross-entropy difference.

Two bigram models over the words of the texts share one vocabulary, that of the
whole corpus, which grows with it. The target model is trained on the documents
labelled good (quality 1, toxic 0), the background model on all documents; they
are matched: same order, same smoothing, and counts of the background scaled to
the target's size. A document is scored by models that have not seen it: its own
counts are taken off first. With n the counts, V the vocabulary, b the word
before c (or the start of the text) and k the strength:

    P(c)   = (n(c) + 1) / (N + V)
    P(c|b) = (n(bc) + k P(c)) / (n(b.) + k)

A document's score is the mean, over its words, of -ln P_target + ln P_background:
the lower, the more it is like the target.

1. Texts are written to files of about `part_bytes` in the shared folder. A part
   counts its words, contexts and bigrams and sends the counts, sorted by hash
   and cut into `shards` ranges of hashes, on their way.
2. A shard adds up the counts of its range over all parts, and answers every part
   with the totals, in the order in which it asked.
3. A part reads its texts again and scores them with its totals, some whole texts
   at a time.

So a frequent bigram meets as one row of each part, not of each document, no task
holds more than a part or a shard, and no model goes to the driver but the
numbers N and V. Texts are not shuffled.

Defined results: words are as in _arrow; a null or empty text has 0 tokens and
null losses. Repeated rows count as often as they occur (a copy's own counts are
those of one row), and each is scored; repeated labels of a doc_id count as good
if any is. Rows with a null doc_id are scored and not good. Without a good
document all target counts are 0 and its model is uniform. A text of any length
is scored whole, in a part of its own if it is longer than that. An empty table
gives an empty result. Other columns are not read. Hashes have 64 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm._arrow import mix, slices, split_words
from latticework.llm._files import read_file, write_file
from latticework.session import scratch_path, ship, stash

_START = np.uint64(0x3C79AC492BA7B653)
_SALTS = tuple(np.uint64(x) for x in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x8CB92BA72F3D8DD7))
_WORD, _CONTEXT, _BIGRAM = range(3)
_OUT = "doc_id long, n_tokens long, loss_target double, loss_background double, loss_difference double"


def _spool(path: str, part_bytes: int, part_rows: int):
    """Write the texts to files; a row (part, path, doc_id) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = made = 0

        def close() -> pa.RecordBatch:
            nonlocal size, made
            t = pa.Table.from_batches(held).combine_chunks()
            file = f"{path}/{uuid.uuid4().hex}.parquet"
            write_file(file, t)
            part = TaskContext.get().partitionId() << 24 | made
            held.clear()
            size, made = 0, made + 1
            doc = t.column("doc_id").combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([part] * len(t), pa.int64()), pa.array([file] * len(t)), doc], ["part", "path", "doc_id"])

        for b in slices(batches, "text", min(part_bytes, 2_000_000)):
            held.append(b)
            size += b.column("text").nbytes
            if size >= part_bytes or sum(map(len, held)) >= part_rows:
                yield close()
        if held:
            yield close()

    return run


def word_hashes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the texts' offsets."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for b in slices(iter(pa.table({"text": texts}).to_batches()), "text", 1_000_000):
        w = split_words(b.column("text"))
        parts.append(w.hashes())
        sizes.append(np.diff(w.at))
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def spans(at: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` words, one text at least; what is made of a part's words is made of one range at a time."""
    cuts = [0, *(np.flatnonzero(np.diff(at[:-1] // most)) + 1).tolist(), len(at) - 1]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def keys(kind: int, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the word, of its context, or of both."""
    with np.errstate(over="ignore"):
        if kind == _WORD:
            return mix(h ^ _SALTS[0])
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[at[:-1][np.diff(at) > 0]] = _START
        return mix(before ^ _SALTS[1]) if kind == _CONTEXT else mix(before * _SALTS[2] + h)


def all_keys(kind: int, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty_like(h)
    for a, b in spans(at):
        out[at[a] : at[b]] = keys(kind, h[at[a] : at[b]], at[a : b + 1] - at[a])
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, ascending, and how often each occurs; x is sorted in place."""
    x.sort()
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    head = np.flatnonzero(first)
    n = np.empty(len(head), np.int32)  # of one part
    np.subtract(head[1:], head[:-1], out=n[:-1], casting="unsafe")
    n[-1:] = len(x) - head[-1:]
    return x[head], n


def places(found: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of x stands in found, which is ascending; sorted first, as they are then looked up from near to near."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.searchsorted(found, x[order])
    return out


def shards_of(kind: int, shards: int) -> tuple[int, int]:
    """First shard and number of shards of a kind; there are far fewer words than bigrams."""
    few = -(-shards // 8)
    return (0, few) if kind == _WORD else (few, few) if kind == _CONTEXT else (2 * few, shards)


def pack(x: np.ndarray, kind: type = np.int64) -> bytes:
    """Numbers byte plane by byte plane, compressed, with their count ahead."""
    x = x.astype(kind, copy=False)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.data.cast("B"), asbytes=True) if len(x) else bytes(8)


def unpack(data: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    raw, size = data.as_buffer(), np.dtype(kind).itemsize
    n = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw.slice(8), n * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def _good(t: pa.Table, goods: pa.Scalar) -> np.ndarray:
    """Which documents of a part are good."""
    return np.asarray(pc.fill_null(pc.is_in(t.column("doc_id"), value_set=goods.values, skip_nulls=True), False))


def _count(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path, goods in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), batch.column("goods")):
                t = read_file(path)
                h, at = word_hashes(t.column("text"))
                good = np.repeat(_good(t, goods), np.diff(at))
                del t
                for kind in (_WORD, _CONTEXT, _BIGRAM):
                    every = all_keys(kind, h, at)
                    of_good, times = distinct(every[good])
                    found, n = distinct(every)
                    del every
                    g = np.zeros(len(found), np.int32)
                    g[np.searchsorted(found, of_good)] = times
                    # equal ranges of hashes
                    start, most = shards_of(kind, shards)
                    cut = np.append(np.searchsorted(found, np.array([-(-(s << 32) // most) << 32 for s in range(most)], np.uint64)), len(found))
                    some = np.flatnonzero(np.diff(cut))
                    rows = [slice(cut[s], cut[s + 1]) for s in some.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some + start, pa.int32()),
                            pa.array([part] * len(some), pa.int64()),
                            pa.array([pack(np.diff(found[r].view(np.int64), prepend=0)) for r in rows], pa.binary()),
                            *(pa.array([pack(x[r], np.int32) for r in rows], pa.binary()) for x in (n, g)),  # of one part
                        ],
                        ["shard", "part", "keys", "n", "g"],
                    )

    return run


def _total(shards: int):
    """The totals of a shard's keys, for each part those that it has; and the shard's share of the vocabulary and of all tokens."""
    word_shards = shards_of(_WORD, shards)[1]

    def run(t: pa.Table) -> pa.Table:
        return _totals(t, t.column("shard")[0].as_py() < word_shards)

    return run


def _totals(t: pa.Table, words: bool) -> pa.Table:
    ks = [np.cumsum(unpack(x)) for x in t.column("keys")]
    key = np.concatenate(ks).view(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.empty(len(key), np.int64)
    group[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
    sums = []
    for c in ("n", "g"):
        x = np.concatenate([unpack(x, np.int32) for x in t.column(c)]).astype(np.int64)
        sums.append(np.add.reduceat(x[order], head))
    ends = np.cumsum([len(x) for x in ks])
    rows = [group[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    first = lambda x: pa.array([int(x)] + [0] * (len(rows) - 1), pa.int64())
    return pa.table(
        {
            "part": t.column("part"),
            "shard": t.column("shard"),
            **{c: pa.array([pack(x[r]) for r in rows], pa.binary()) for c, x in zip(("n", "g"), sums)},
            "vocabulary": first(len(head) if words else 0),
            "all_n": first(sums[0].sum() if words else 0),
            "all_g": first(sums[1].sum() if words else 0),
        }
    )


def own_counts(index: np.ndarray, owner: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often the document of each row has that row's key itself; total: how often the corpus has it."""
    out = np.ones(len(index), np.int64)
    some = np.flatnonzero(total > 1)
    pair = owner[some] << 32 | index[some]
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(pair)))
    out[some[order]] = np.repeat(n, n)
    return out


def _score(k: float, vocabulary: int, corpus_n: int, corpus_g: int):
    scale = corpus_g / corpus_n if corpus_n else 0.0

    def run(values: pa.Table, part: pa.Table) -> pa.Table:
        values = values.sort_by("shard")
        totals = [np.concatenate([np.zeros(0, np.int64), *(unpack(x) for x in values.column(c))]) for c in ("n", "g")]
        t = read_file(part.column("path")[0].as_py())
        h, at = word_hashes(t.column("text"))
        good = _good(t, part.column("goods")[0])
        ids = t.column("doc_id")
        del t, values
        # the keys of a kind, ascending, stand in the order of their totals
        found = [distinct(all_keys(kind, h, at))[0] for kind in (_WORD, _CONTEXT, _BIGRAM)]
        starts = np.cumsum([0, *map(len, found)])
        size = np.diff(at)
        means = np.full((2, len(size)), np.nan)
        for a, b in spans(at):
            some, words = size[a:b], h[at[a] : at[b]]
            near = at[a : b + 1] - at[a]
            owner = np.repeat(np.arange(b - a), some)
            of_good = good[a:b][owner]
            n, g = [], []
            for kind in (_WORD, _CONTEXT, _BIGRAM):
                index = places(found[kind], keys(kind, words, near))
                all_n, good_n = (x[starts[kind] : starts[kind + 1]][index] for x in totals)
                own = own_counts(index, owner, all_n)
                n.append(all_n - own)
                g.append(good_n - own * of_good)
            full = some > 0
            if not full.any():
                continue
            for i, (x, everything) in enumerate(((g, corpus_g - some * good[a:b]), ([scale * y for y in n], scale * (corpus_n - some)))):
                p = (x[_WORD] + 1) / (everything[owner] + vocabulary)
                loss = -np.log((x[_BIGRAM] + k * p) / (x[_CONTEXT] + k))
                means[i, a:b][full] = np.add.reduceat(loss, near[:-1][full]) / some[full]
        cols = [ids, pa.array(size), *(pa.array(x, from_pandas=True) for x in (*means, means[0] - means[1]))]
        return pa.Table.from_arrays(cols, ["doc_id", "n_tokens", "loss_target", "loss_background", "loss_difference"])

    return run


def score(docs: DataFrame, labels: DataFrame, k: float = 4.0, part_bytes: int = 6_000_000, part_rows: int = 100_000, shards: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, loss_difference) for every document.

    shards: ranges of hashes for the bigrams; by default as many as there are
    parts, 256 at least. Parts times shards rows are shuffled, so both should be as large as the
    memory of a task lets them be: some 15 bytes for each byte of a part.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    good = labels.filter("quality = 1 and toxic = 0").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    ids = stash(d.mapInArrow(_spool(scratch_path(spark, "lm-texts"), part_bytes, part_rows), "part long, path string, doc_id long"), "lm-ids")
    marked = ids.distinct().join(good, "doc_id", "left")
    # a part has part_rows documents, and what one more slice holds, at most
    parts = stash(marked.groupBy("part", "path").agg(F.collect_list(F.when(F.col("good"), F.col("doc_id"))).alias("goods")), "lm-parts")
    made = max(1, parts.count())
    shards = shards or max(made, 256)
    busy = 3 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = parts.repartition(min(made, busy), "part").mapInArrow(_count(shards), "shard int, part long, keys binary, n binary, g binary")
    totals = stash(
        counts.repartition(min(2 * shards, busy), "shard").groupBy("shard").applyInArrow(_total(shards), "part long, shard int, n binary, g binary, vocabulary long, all_n long, all_g long"), "lm-totals"
    )
    sums = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("vocabulary", "all_n", "all_g"))).first()
    values = totals.select("part", "shard", "n", "g").repartition(min(made, busy), "part").groupBy("part")
    out = values.cogroup(parts.repartition(min(made, busy), "part").groupBy("part")).applyInArrow(_score(k, max(sums[0], 1), sums[1], sums[2]), _OUT)
    return out.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "loss_difference")))


ORACLE = r"""
with d as (select row_number() over () as row, doc_id, text from documents),
good as (select distinct doc_id from labels where quality = 1 and toxic = 0),
h as (select row, doc_id, coalesce(doc_id in (select doc_id from good where doc_id is not null), false) as good, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-`{-\x7f]+'), lambda x: x <> '') as w from d),
u as (select row, good, unnest(w) as c, generate_subscripts(w, 1) as i from h),
t as (select row, good, c, coalesce(lag(c) over (partition by row order by i), '') as b from u),
n1 as (select c, count(*) as n, count(*) filter (where good) as g from t group by c),
nb as (select b, count(*) as n, count(*) filter (where good) as g from t group by b),
n2 as (select b, c, count(*) as n, count(*) filter (where good) as g from t group by b, c),
z as (select count(*) as v, coalesce(sum(n), 0) as n, coalesce(sum(g), 0) as g, coalesce(sum(g) / sum(n), 0)::double as scale from n1),
o as (select *, count(*) over (partition by row) as own, count(*) over (partition by row, c) as own1, count(*) over (partition by row, b) as ownb, count(*) over (partition by row, b, c) as own2 from t),
x as (select row, unnest([0, 1]) as model, v, unnest([(z.g - case when good then own else 0 end)::double, scale * (z.n - own)]) as total,
    unnest([(n1.g - case when good then own1 else 0 end)::double, scale * (n1.n - own1)]) as c1, unnest([(nb.g - case when good then ownb else 0 end)::double, scale * (nb.n - ownb)]) as cb,
    unnest([(n2.g - case when good then own2 else 0 end)::double, scale * (n2.n - own2)]) as c2
  from o join n1 on n1.c = o.c join nb on nb.b = o.b join n2 on n2.b = o.b and n2.c = o.c, z),
l as (select row, model, avg(-ln((c2 + 4.0::double * (c1 + 1) / (total + v)) / (cb + 4.0::double))) as loss from x group by row, model),
s as (select row, max(loss) filter (where model = 0) as t, max(loss) filter (where model = 1) as b from l group by row)
select doc_id, len(w)::bigint as n_tokens, round(t, 6) as loss_target, round(b, 6) as loss_background, round(t - b, 6) as loss_difference from h left join s using (row)
"""
