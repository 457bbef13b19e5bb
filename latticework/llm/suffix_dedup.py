"""Operator 8, suffix-array dedup: repeated passages by external induced sorting.

A window is `min_words` words in a row. A window that occurred before, in an
earlier document (by doc_id) or earlier in the same one, is a repeat; the words
that repeats cover are the repeated passages, whose first occurrence stays.

1. Every window is keyed by the smallest hash of the `gram`-word sequences in
   it. Equal windows have equal keys, wherever they are. Windows in a row with
   one key form a segment; a segment's row holds its key and a hash of its words.
2. Rows meet by key, in the order of Spark's external sort, and go by as a stream.
   A key with one segment cannot hold a repeat (unless its sequence recurs inside
   of the segment). Of segments with equal words the first stands for all.
3. Where a key has several different segments, their words are fetched, again in
   order of keys, and cut into shards of whole keys. The suffixes of each shard
   are sorted with their common-prefix values by external induced sorting (see
   _induced). Suffixes that share at least min_words words are neighbours in that
   order; the first of them by (doc_id, position) is the original, the others are
   repeats.
4. A key with more than `hot_rows` segments, such as a site's notice inside of
   many different pages, is split: its windows are keyed by the hash of all their
   words, so that only equal windows have one key, and the first of these is the
   original.

All repeats are found, however the corpus is cut into shards, as equal windows
always share a shard, or a key of their own. A shard ends with the key with which
it reaches `shard_words`, and a key that is not split has hot_rows times
(2 min_words - gram) words at most, so what a task holds is bounded by these
parameters, not by its partition; the queue of suffix tuples spills beyond
`memory` of them to the shared folder.

Defined results: words are as in _arrow; texts shorter than min_words words
(null, empty) have no repeats. Rows with a null doc_id take no part and stay as
they are. Rows that repeat doc_id and text are one document: both get the same
result, and they are no repeats of each other. Different texts of one doc_id are
different documents, of which `repeats` gives a row each. A passage may repeat inside of
one document. Other columns are not read by `repeats` and kept by `apply`; an
empty table gives an empty result. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm._arrow import mix, powers, ragged, slices, split_words
from latticework.llm._induced import Spill, suffix_array
from latticework.session import shared_dir, ship, stash

_SPAN = "doc_id long, text_key long, first long, windows long, source long"


class Grams:
    """Hashes of word sequences, from prefix sums over one slice of texts."""

    def __init__(self, h: np.ndarray) -> None:
        self.up, self.down = powers(len(h) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)])])

    def of(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[first + size] - self.sums[first]) * self.down[first] + np.asarray(size).astype(np.uint64))


def segments(h: np.ndarray, at: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """Key, first window, number of windows, hash of the words, and whether the key's sequence recurs, of each segment.

    h: word hashes of texts, one after the other; at: n + 1 word offsets.
    """
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < min_words:
        return none.view(np.uint64), none, none, none.view(np.uint64), none.astype(bool)
    grams = Grams(h)
    g = grams.of(np.arange(n - gram + 1), gram)
    wide = min_words - gram + 1
    low, size = g, 1
    while 2 * size <= wide:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if wide > size:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    ends = np.repeat(at[1:], np.diff(at))[: len(low)]
    ok = np.arange(len(low)) + min_words <= ends
    same = np.zeros(len(low), bool)
    same[1:] = ok[1:] & ok[:-1] & (low[1:] == low[:-1])
    first = np.flatnonzero(ok & ~same)
    count = np.diff(np.append(np.flatnonzero((ok & ~same)[ok]), int(ok.sum())))
    key = low[first]
    span = count + wide - 1
    inside = np.repeat(first, span) + ragged(span)
    hits = np.add.reduceat((g[inside] == np.repeat(key, span)).astype(np.int32), np.cumsum(span) - span) if len(first) else none
    return key, first, count, grams.of(first, count + min_words - 1), hits > 1


def _segment_rows(min_words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = split_words(b.column("text"))
            key, first, count, body, recurs = segments(w.hashes(), w.at, min_words, gram)
            doc = np.searchsorted(w.at, first, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(body.view(np.int64)), b.column("doc_id").take(pa.array(doc)), b.column("text_key").take(pa.array(doc)), pa.array((first - w.at[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(recurs)],
                ["key", "body", "doc_id", "text_key", "first", "windows", "recurs"],
            )

    return run


def keyed(batches: Iterator[pa.RecordBatch], least: int, weight: str | None = None) -> Iterator[pa.Table]:
    """Rows that come ordered by key, as tables of whole keys with `least` rows, or words in a column, or somewhat more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        key = b.column("key").to_numpy()
        while len(b):
            if size >= least:
                # the rest of the last key, then a new table
                last = held[-1].column("key")[-1].as_py()
                n = int(np.searchsorted(key != last, True)) if key[0] == last else 0
                n = len(b) if n == 0 and (key == last).all() else n
                if n:
                    held.append(b.slice(0, n))
                    b, key = b.slice(n), key[n:]
                if len(b):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                continue
            if weight:
                w = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(weight)), 0)).astype(np.int64) // 8 + 1)
                n = min(len(b), int(np.searchsorted(w, least - size)) + 1)
                size += int(w[n - 1])
            else:
                n = min(len(b), least - size)
                size += n
            held.append(b.slice(0, n))
            b, key = b.slice(n), key[n:]
    if held:
        yield pa.Table.from_batches(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep rows whose key may hold repeats; `lead_doc` has the first segment with the same words, `sort` says that its words are needed.

    Rows come ordered by (key, body, doc_id, first, text_key).
    """
    for t in keyed(batches, 100_000):
        c = {x: t.column(x).to_numpy() for x in t.column_names}
        new_body = np.ones(len(t), bool)
        new_body[1:] = (c["key"][1:] != c["key"][:-1]) | (c["body"][1:] != c["body"][:-1])
        again = np.zeros(len(t), bool)  # the same place of a repeated row
        again[1:] = ~new_body[1:] & (c["doc_id"][1:] == c["doc_id"][:-1]) & (c["first"][1:] == c["first"][:-1]) & (c["text_key"][1:] == c["text_key"][:-1])
        c, new_body = {x: y[~again] for x, y in c.items()}, new_body[~again]
        new_key = np.ones(len(new_body), bool)
        new_key[1:] = c["key"][1:] != c["key"][:-1]
        key_of = np.cumsum(new_key) - 1
        bodies, rows = np.bincount(key_of, weights=new_body), np.bincount(key_of)
        recurs = np.maximum.reduceat(c["recurs"].astype(np.int8), np.flatnonzero(new_key)) > 0
        sort = ((bodies > 1) | recurs)[key_of]
        keep = sort | (rows > 1)[key_of]
        lead = np.flatnonzero(new_body)[np.cumsum(new_body) - 1]
        out = {x: c[x] for x in ("key", "body", "doc_id", "text_key", "first", "windows")} | {"lead_doc": c["doc_id"][lead], "is_lead": new_body, "sort": sort}
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in out.values()], list(out))


def _fetch(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = split_words(b.column("text"))
            h = w.hashes()
            wanted = b.column("wanted")
            n = np.asarray(wanted.value_lengths())
            row = np.repeat(np.arange(len(b)), n)
            x = wanted.flatten()
            first, windows = np.asarray(x.field("first")).astype(np.int64), np.asarray(x.field("windows")).astype(np.int64)
            size = windows + min_words - 1
            words = h[np.repeat(w.at[row] + first, size) + ragged(size)]
            ends = np.concatenate([[0], np.cumsum(size)]) * 8
            cells = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words)]).cast(pa.binary())
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([x.field("key"), x.field("body"), b.column("doc_id").take(rows), b.column("text_key").take(rows), x.field("first"), x.field("windows"), cells], ["key", "body", "doc_id", "text_key", "first", "windows", "words"])

    return run


def _window_hashes(min_words: int):
    """(key, doc_id, text_key, first): the hash of all words of each wanted window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = split_words(b.column("text"))
            grams = Grams(w.hashes())
            wanted = b.column("wanted")
            row = np.repeat(np.arange(len(b)), np.asarray(wanted.value_lengths()))
            x = wanted.flatten()
            first, windows = np.asarray(x.field("first")).astype(np.int64), np.asarray(x.field("windows")).astype(np.int64)
            at = np.repeat(w.at[row] + first, windows) + ragged(windows)
            row = pa.array(np.repeat(row, windows))
            key = grams.of(at, min_words).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("doc_id").take(row), b.column("text_key").take(row), pa.array(at - w.at[np.asarray(row)])], ["key", "doc_id", "text_key", "first"])

    return run


def _sort(min_words: int, folder: str, memory: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in keyed(batches, shard_words, "words"):
            yield from shard(t)

    def shard(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {x: t.column(x).to_numpy() for x in t.column_names if x != "words"}
        has = np.asarray(t.column("words").is_valid())
        lead, copies = np.flatnonzero(has), np.flatnonzero(~has)
        o = np.lexsort((c["text_key"][lead], c["first"][lead], c["doc_id"][lead], c["body"][lead], c["key"][lead]))
        lead = lead[o]
        once = np.ones(len(lead), bool)  # a repeated row's words come twice
        once[1:] = (c["key"][lead][1:] != c["key"][lead][:-1]) | (c["body"][lead][1:] != c["body"][lead][:-1])
        lead = lead[once]
        words = t.column("words").cast(pa.large_binary()).combine_chunks()
        del t
        parts = [np.frombuffer(words[i].as_buffer(), np.uint64) for i in lead.tolist()]
        size = np.array([len(x) for x in parts], np.int64)
        everything = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        del parts, words
        if not len(everything):
            return
        # ranks, frequent words last: a sweep then seldom adds to the range at hand
        _, rank, count = np.unique(everything, return_inverse=True, return_counts=True)
        place = np.empty(len(count), np.int64)
        place[np.argsort(count, kind="stable")] = np.arange(len(count))
        m = len(lead)
        text = np.zeros(len(everything) + m + 1, np.int64)
        start = np.cumsum(size + 1) - size - 1
        text[np.repeat(start, size) + ragged(size)] = place[rank] + m + 1
        text[start + size] = np.arange(1, m + 1)  # each segment has an end of its own
        del everything, rank
        spill = Spill(folder)
        try:
            order, lcp = suffix_array(text, min_words, spill, memory)
        finally:
            spill.close()
        # suffixes that share min_words words
        joined = lcp >= min_words
        joined |= np.append(joined[1:], False)
        order, fresh = order[joined], (lcp < min_words)[joined]
        seg = np.searchsorted(start, order, "right") - 1
        doc, spot = c["doc_id"][lead][seg], c["first"][lead][seg].astype(np.int64) + order - start[seg]
        key = c["text_key"][lead][seg]
        group = np.cumsum(fresh) - 1
        o = np.lexsort((key, spot, doc, group))
        order, seg, doc, group = order[o], seg[o], doc[o], group[o]
        head = np.ones(len(order), bool)
        head[1:] = group[1:] != group[:-1]
        source = doc[np.flatnonzero(head)][group] if len(order) else doc
        # by place: the original of every window of a lead segment, and whether that is itself
        original = np.repeat(c["doc_id"][lead], size + 1)
        original = np.append(original, 0)
        repeat = np.zeros(len(text), bool)
        original[order] = source
        repeat[order] = ~head
        windows = c["windows"][lead].astype(np.int64)
        at = np.repeat(start, windows) + ragged(windows)
        own = np.repeat(np.arange(m), windows)
        out = [_runs(own[repeat[at]], (at - start[own])[repeat[at]], original[at][repeat[at]], lead, c)]
        # copies repeat all windows of their lead
        pair = np.stack([c["key"], c["body"]], axis=1)
        if len(copies):
            of = _find(pair[lead], pair[copies])
            windows = windows[of]
            at = np.repeat(start[of], windows) + ragged(windows)
            own = np.repeat(np.arange(len(copies)), windows)
            out.append(_runs(own, at - np.repeat(start[of], windows), original[at], copies, c))
        for x in out:
            yield from x

    return run


def _find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The row of `table`, which is ordered, that equals each row of `wanted`."""
    both = np.concatenate([table, wanted])
    o = np.lexsort((np.arange(len(both)) >= len(table), both[:, 1], both[:, 0]))
    at = np.where(o < len(table), o, -1)
    last = np.maximum.accumulate(np.where(at >= 0, np.arange(len(o)), 0))
    found = np.empty(len(both), np.int64)
    found[o] = o[last]
    return found[len(table) :]


def _runs(own: np.ndarray, offset: np.ndarray, source: np.ndarray, rows: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Repeated windows as rows (document, first window, number of windows, source)."""
    if not len(own):
        return
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (offset[1:] != offset[:-1] + 1) | (source[1:] != source[:-1])
    head = np.flatnonzero(new)
    r = rows[own[head]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (c["doc_id"][r], c["text_key"][r], c["first"][r].astype(np.int64) + offset[head], np.diff(np.append(head, len(own))), source[head])],
        ["doc_id", "text_key", "first", "windows", "source"],
    )


def windows(docs: DataFrame, min_words: int = 50, gram: int = 16, memory: int = 4_000_000, shard_words: int = 200_000, hot_rows: int = 10_000) -> DataFrame:
    """(doc_id, text_key, first, windows, source): runs of repeated windows; rows may overlap."""
    if not 0 < gram <= min_words:
        raise ValueError("gram must be between 1 and min_words")
    spark = docs.sparkSession
    ship(spark)
    d = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    rows = stash(d.mapInArrow(_segment_rows(min_words, gram), "key long, body long, doc_id long, text_key long, first int, windows int, recurs boolean"), "suffix-rows")
    # rows with equal words lie in one shard as one, so a key is as large as its different segments
    hot = stash(rows.groupBy("key", "body").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("bodies"), F.sum("n").alias("n")).filter(F.col("n") > hot_rows).select("key"), "suffix-hot")
    some_hot = not hot.isEmpty()
    usual = rows.join(hot, "key", "left_anti") if some_hot else rows
    order = ["key", "body", "doc_id", "first", "text_key"]
    met = stash(
        usual.repartition("key").sortWithinPartitions(*order).mapInArrow(_meet, "key long, body long, doc_id long, text_key long, first int, windows int, lead_doc long, is_lead boolean, sort boolean"),
        "suffix-keys",
    )
    out = met.filter("not sort and not is_lead").select("doc_id", "text_key", F.col("first").cast("bigint").alias("first"), F.col("windows").cast("bigint").alias("windows"), F.col("lead_doc").alias("source"))
    need = met.filter("sort and is_lead").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("key", "body", "first", "windows")).alias("wanted"))
    body = "key long, body long, doc_id long, text_key long, first int, windows int, words binary"

    def texts(need: DataFrame) -> DataFrame:
        return d.join(need.hint("shuffle_hash"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "wanted")

    copies = met.filter("sort and not is_lead").select("key", "body", "doc_id", "text_key", "first", "windows", F.lit(None).cast("binary").alias("words"))
    shards = texts(need).mapInArrow(_fetch(min_words), body).unionByName(copies).repartition("key").sortWithinPartitions("key")
    out = out.unionByName(shards.mapInArrow(_sort(min_words, shared_dir(spark), memory, shard_words), _SPAN))
    if some_hot:
        need = rows.join(hot, "key").select("doc_id", "text_key", "first", "windows").distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "windows")).alias("wanted"))
        at = stash(texts(need).mapInArrow(_window_hashes(min_words), "key long, doc_id long, text_key long, first long").distinct(), "suffix-windows")
        # added up within tasks first; a frequent window's rows are split by the adaptive skew join
        first = at.groupBy("key").agg(F.min(F.struct("doc_id", "first", "text_key")).alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead")
        more = at.join(first, "key").filter(F.struct("doc_id", "first", "text_key") != F.col("lead"))
        out = out.unionByName(more.select("doc_id", "text_key", "first", F.lit(1).cast("bigint").alias("windows"), F.col("lead")["doc_id"].alias("source")))
    return out


def _merged(found: DataFrame, min_words: int) -> DataFrame:
    """Spans of words [first_word, end_word) that repeated windows cover, without overlaps, and the smallest source of each."""
    w = Window.partitionBy("doc_id", "text_key").orderBy("first", "windows", "source")
    d = found.withColumn("end", F.col("first") + F.col("windows") + (min_words - 1))
    d = d.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("island", F.sum(F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).over(w))
    return d.groupBy("doc_id", "text_key", "island").agg(F.min("first").alias("first_word"), F.max("end").alias("end_word"), F.min("source").alias("source_doc"))


def repeats(docs: DataFrame, min_words: int = 50, gram: int = 16, memory: int = 4_000_000, shard_words: int = 200_000, hot_rows: int = 10_000) -> DataFrame:
    """(doc_id, first_word, end_word, source_doc): every repeated passage but its first occurrence."""
    return _merged(windows(docs, min_words, gram, memory, shard_words, hot_rows), min_words).select("doc_id", "first_word", "end_word", "source_doc")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans; what lies between two cut words goes too."""
    for b in slices(batches, "text"):
        texts, spans = b.column("text").to_pylist(), b.column("spans").to_pylist()
        todo = [i for i, x in enumerate(spans) if x and texts[i]]
        if todo:
            w = split_words(pa.array([texts[i] for i in todo], pa.string()))
            starts = np.cumsum((w.data & 0xC0) != 0x80)
            for k, i in enumerate(todo):
                zero = int(starts[w.text_at[k] - 1]) if w.text_at[k] else 0
                out, at = [], 0
                for s in spans[i]:
                    a, z = int(w.at[k]) + s["first_word"], int(w.at[k]) + s["end_word"]
                    a_char = int(starts[w.start[a]]) - 1 - zero
                    z_char = int(starts[w.start[z]]) - 1 - zero if z < w.at[k + 1] else len(texts[i])
                    out.append(texts[i][at:a_char])
                    at = z_char
                out.append(texts[i][at:])
                texts[i] = "".join(out)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def apply(docs: DataFrame, min_words: int = 50, gram: int = 16, memory: int = 4_000_000, shard_words: int = 200_000, hot_rows: int = 10_000) -> DataFrame:
    """Documents without their repeated passages; a document of which no word is left goes."""
    names = docs.columns
    spans = _merged(windows(docs, min_words, gram, memory, shard_words, hot_rows), min_words)
    spans = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("spans"))
    spans = stash(spans, "suffix-spans")
    row = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), F.col("doc_id").cast("bigint").alias("k0"), F.xxhash64("text").alias("k1"), F.col("text"))
    joined = row.join(spans.hint("shuffle_hash"), (row["k0"] == spans["doc_id"]) & (row["k1"] == spans["text_key"]), "left")
    hit, clean = joined.filter("spans is not null"), joined.filter("spans is null").select("row.*")
    kind = row.select("row").schema["row"].dataType.simpleString()
    cut = hit.select("row", "text", "spans").mapInArrow(_cut, f"row {kind}, text string").filter(F.col("text").rlike(r"[\p{L}\p{N}]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return clean.unionByName(cut.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names)))


ORACLE = r"""
with w as (select distinct doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-`{-\x7f]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50),
g as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from p),
f as (select doc_id, i, row_number() over o as n, first_value(doc_id) over o as source from g window o as (partition by h order by doc_id, i)),
r as (select doc_id, i, source, i - lag(i) over (partition by doc_id order by i) > 50 as gap from f where n > 1),
s as (select doc_id, i, source, sum(case when gap then 1 else 0 end) over (partition by doc_id order by i) as island from r)
select doc_id, (min(i) - 1)::bigint as first_word, (max(i) + 49)::bigint as end_word, min(source) as source_doc from s group by doc_id, island
"""
