"""Operator 7, language identification of spans in mixed-language text.

The script of each word (Unicode ranges of its first character) narrows the
languages that it may be in: the trained languages that are mainly written in
that script, or, where none is, the script's usual language. A trained language
scores a word by the log probabilities of its byte trigrams, the blanks around
it included. Viterbi over the words of a document, with a penalty for each
switch, then gives the best sequence of languages, and runs of one language are
the spans. Words of digits alone say nothing for or against a language.

The trigram tables are fitted on a sample of at most `train_docs` documents per
language label, those whose hashed doc_id comes first (of texts with one doc_id
the smallest); this bound is the only one. Every document is labelled over its whole text.

Viterbi runs over blocks of words at once: first the best score from each state
before a block to each state at its end, then the best states at the block ends
of every document, then the path within each block. The result is the exact
best path. At equal scores a path stays in its language, and otherwise takes
the language that comes first by name.

Defined results: a text without words (null, empty, symbols alone) gives one row
with lang "und" and no words; one of digits alone a span of lang "und". Repeated rows are labelled each on their own; an
empty table gives an empty result; with no labelled rows all Latin words are
"und". Null languages are not trained on. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm._arrow import Words, slices, split_words
from latticework.session import ship, stash

#: First code point, script, usual language of a script.
_RANGES = [
    (0x0, "common", None), (0x41, "latin", "und"), (0x5B, "common", None), (0x61, "latin", "und"), (0x7B, "common", None), (0xAA, "latin", "und"), (0xAB, "common", None),
    (0xC0, "latin", "und"), (0x250, "common", None), (0x370, "greek", "el"), (0x400, "cyrillic", "ru"), (0x530, "armenian", "hy"), (0x590, "hebrew", "he"), (0x600, "arabic", "ar"),
    (0x700, "common", None), (0x900, "devanagari", "hi"), (0x980, "bengali", "bn"), (0xA00, "common", None), (0xB80, "tamil", "ta"), (0xC00, "common", None), (0xE00, "thai", "th"),
    (0xE80, "common", None), (0x10A0, "georgian", "ka"), (0x1100, "hangul", "ko"), (0x1200, "ethiopic", "am"), (0x1380, "common", None), (0x1E00, "latin", "und"), (0x1F00, "greek", "el"),
    (0x2000, "common", None), (0x3040, "kana", "ja"), (0x3100, "common", None), (0x3400, "han", "zh"), (0xA000, "common", None), (0xAC00, "hangul", "ko"), (0xD7B0, "common", None),
    (0xF900, "han", "zh"), (0xFB00, "common", None), (0x20000, "han", "zh"), (0x30000, "common", None),
]
_STARTS = np.array([r[0] for r in _RANGES])
SCRIPTS = sorted({r[1] for r in _RANGES})
USUAL = {r[1]: r[2] for r in _RANGES}
_SCRIPT = np.array([SCRIPTS.index(r[1]) for r in _RANGES], np.int8)
_COMMON = SCRIPTS.index("common")
_CELLS = 1 << 16
_NEVER = -1e9


def scripts(w: Words) -> np.ndarray:
    """The script of each word, as an index of SCRIPTS; that of its first character that is not common."""
    data = w.data
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b0 = data[lead].astype(np.int64)
    nxt = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 63
    code = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | nxt(1), np.where(b0 < 0xF0, (b0 & 15) << 12 | nxt(1) << 6 | nxt(2), (b0 & 7) << 18 | nxt(1) << 12 | nxt(2) << 6 | nxt(3))))
    script = _SCRIPT[np.searchsorted(_STARTS, code, "right") - 1]
    known = script != _COMMON
    at, value = lead[known], script[known]
    k = np.searchsorted(at, w.start)
    inside = k < len(at)
    inside[inside] = at[k[inside]] < w.end[inside]
    out = np.full(len(w.start), _COMMON, np.int8)
    out[inside] = value[k[inside]]
    return out


def trigram_cells(w: Words) -> np.ndarray:
    """A cell for each byte, from it and its neighbours; bytes outside of words count as blanks."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] += 1
    np.add.at(inside, w.end, -1)
    x = np.where(np.cumsum(inside[:-1]) > 0, w.data, 32).astype(np.uint32)
    before, after = np.full_like(x, 32), np.full_like(x, 32)
    before[1:], after[:-1] = x[:-1], x[1:]
    first, last = w.text_at[:-1], w.text_at[1:] - 1
    some = last >= first
    before[first[some]], after[last[some]] = 32, 32
    return ((before << 16 | x << 8 | after) * np.uint32(2654435761)) >> np.uint32(16)


def _fit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        w = split_words(b.column("text"))
        cell, lang = trigram_cells(w), np.asarray(b.column("lang").to_pandas())
        owner = np.repeat(np.arange(len(lang)), np.diff(w.text_at))
        script, of = scripts(w), w.owner()
        wide = np.zeros(len(w.data) + 1, np.int8)
        wide[w.start] += 1
        np.add.at(wide, w.end, -1)
        word_byte = np.cumsum(wide[:-1]) > 0
        for x in np.unique(lang):
            mine = lang == x
            n = np.bincount(cell[mine[owner] & word_byte], minlength=_CELLS)
            s = np.bincount(script[mine[of]], minlength=len(SCRIPTS))
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([n.astype(np.int64).tobytes()]), pa.array([s.astype(np.int64).tobytes()])], ["lang", "cells", "scripts"])


class Model:
    """Languages, the log probabilities of their trigram cells, and their main scripts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        n = np.array([counts[x][0] for x in self.langs], np.float64).reshape(len(self.langs), _CELLS)
        used = max(1, int((n.sum(0) > 0).sum())) if self.langs else 1
        self.table = np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * (used + 1))).astype(np.float32)
        self.main = []
        for x in self.langs:
            s = counts[x][1].copy()
            s[_COMMON] = 0
            self.main.append(int(s.argmax()) if s.any() else _COMMON)

    def scores(self, w: Words) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages that may occur, by name, the score of each for each word, and which words are of a script."""
        script = scripts(w)
        present = [int(x) for x in np.unique(script) if x != _COMMON]
        usual = {USUAL[SCRIPTS[x]]: x for x in present if x not in self.main}
        names = sorted({*(x for x, m in zip(self.langs, self.main) if m in present), *usual})
        if not names:
            names = ["und"]
        out = np.zeros((len(script), len(names)), np.float32)
        cell = trigram_cells(w)
        word = script != _COMMON
        for k, name in enumerate(names):
            may = np.zeros(len(SCRIPTS), bool)
            if name in self.langs:
                i = self.langs.index(name)
                may[self.main[i]] = True
                total = np.cumsum(self.table[i][cell], dtype=np.float64)
                value = total[w.end - 1] - np.where(w.start > 0, total[w.start - 1], 0) if len(w.start) else np.zeros(0)
                out[:, k] = np.where(word, value, 0)
            for s in (x for n, x in usual.items() if n == name):
                may[s] = True
            out[word & ~may[script], k] = _NEVER
        return names, out, word


def viterbi(score: np.ndarray, at: np.ndarray, penalty: float, block: int = 64) -> np.ndarray:
    """The best state of each word: score (words, states) and at, the n + 1 word offsets of the texts."""
    n, s = score.shape
    if not n:
        return np.zeros(0, np.int64)
    if s == 1:
        return np.zeros(n, np.int64)
    count = np.diff(at)
    blocks = -(-count // block)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    begin = np.repeat(at[:-1], blocks) + (np.arange(total) - np.repeat(first[:-1], blocks)) * block
    size = np.minimum(begin + block, np.repeat(at[1:], blocks)) - begin
    padded = np.zeros((total, block, s), np.float64)
    slot = np.repeat(np.arange(total), size)
    step = np.arange(n) - np.repeat(begin, size)
    padded[slot, step] = score
    live = np.arange(block)[None, :] < size[:, None]
    # best score from state e before the block to state x at its end
    d = np.where(np.eye(s, dtype=bool), 0.0, -np.inf)[None].repeat(total, 0)
    for t in range(block):
        new = np.maximum(d, d.max(2, keepdims=True) - penalty) + padded[:, t, None, :]
        on = live[:, t]
        if on.all():
            d = new
        else:
            d[on] = new[on]
    # over the blocks of each text, longest texts first so that those still running are a prefix
    order = np.argsort(-blocks, kind="stable")
    many = blocks[order]
    came = np.zeros((total, s), np.int64)
    v = np.zeros((len(count), s))
    for k in range(int(many[0]) if len(many) else 0):
        running = order[: int(np.searchsorted(-many, -k, "left"))]
        b = first[running] + k
        candidate = v[running][:, :, None] + d[b]  # v is 0 before a text: any state may come first
        came[b] = _pick(candidate)
        v[running] = candidate.max(1)
    end_state = np.zeros(total, np.int64)
    start_state = np.zeros(total, np.int64)
    for k in range(int(many[0]) - 1 if len(many) else -1, -1, -1):
        running = order[: int(np.searchsorted(-many, -k, "left"))]
        b = first[running] + k
        last = blocks[running] == k + 1
        state = np.where(last, v[running].argmax(1), 0)
        inner = ~last
        state[inner] = start_state[b[inner] + 1]
        end_state[b] = state
        start_state[b] = came[b, state]
    # the path inside of each block
    x = np.full((total, s), -np.inf)
    x[np.arange(total), start_state] = 0
    best, stay = np.zeros((total, block), np.int8), np.zeros((total, block, s), bool)
    for t in range(block):
        top = x.argmax(1)
        jump = x[np.arange(total), top] - penalty
        stay[:, t] = x >= jump[:, None]
        best[:, t] = top
        new = np.maximum(x, jump[:, None]) + padded[:, t]
        on = live[:, t]
        x[on] = new[on]
    path = np.zeros((total, block), np.int64)
    state = end_state
    rows = np.arange(total)
    for t in range(block - 1, -1, -1):
        on = live[:, t]
        path[on, t] = state[on]
        state = np.where(on & ~stay[rows, t, state], best[:, t], state)
    return path[slot, step]


def _pick(candidate: np.ndarray) -> np.ndarray:
    """For each end state the state before the block, of equals that same state, then the first by name."""
    top = candidate.argmax(1)
    s = candidate.shape[1]
    same = candidate[:, np.arange(s), np.arange(s)]
    return np.where(same >= candidate.max(1), np.arange(s)[None, :], top)


def _label(model: Model, penalty: float):
    names = ["doc_id", "span", "lang", "first_word", "n_words", "char_start", "char_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = split_words(batch.column("text"))
            doc = batch.column("doc_id")
            langs, score, known = model.scores(w)
            state = viterbi(score, w.at, penalty)
            owner = w.owner()
            # digits alone are of no language, whatever other texts come in the same batch
            langs, said = [*langs, "und"], np.bincount(owner[known], minlength=len(doc)) > 0
            state = np.where(said[owner], state, len(langs) - 1)
            new = np.ones(len(state), bool)
            new[1:] = (state[1:] != state[:-1]) | (owner[1:] != owner[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(state))
            chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            own, zero = owner[head], chars[w.text_at[:-1]]
            per = np.bincount(own, minlength=len(doc))
            none = np.flatnonzero(per == 0)
            o = np.argsort(np.concatenate([own, none]), kind="stable")
            z = np.zeros(len(none), np.int64)
            cols = [
                np.concatenate([own, none]),
                np.concatenate([np.arange(len(head)) - np.repeat(np.cumsum(per) - per, per), z]),
                np.concatenate([np.array(langs, object)[state[head]] if len(head) else np.zeros(0, object), np.full(len(none), "und", object)]),
                np.concatenate([head - w.at[own], z]),
                np.concatenate([tail - head, z]),
                np.concatenate([chars[w.start[head]] - zero[own], z]),
                np.concatenate([chars[w.end[tail - 1]] - zero[own], z]) if len(head) else z,
            ]
            cols = [c[o] for c in cols]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(cols[0])), pa.array(cols[1]), pa.array(cols[2], pa.string()), *(pa.array(c) for c in cols[3:])], names)

    return run


def sample(docs: DataFrame, train_docs: int, broadcast_limit: int = 100_000, salts: int = 64) -> DataFrame:
    """(lang, text): at most train_docs documents of each label, those whose hashed doc_id comes first.

    Hashes that begin with many zero bits come first. One pass counts, per label
    and number of such bits, the different hashes; a second one takes the texts
    from the least number of bits on that leaves enough, some times train_docs.
    No task ever holds more than that of a label. Up to broadcast_limit labels are
    sent to the texts.
    """
    d = docs.filter("lang is not null and length(text) > 0").select("lang", F.xxhash64("doc_id").alias("h"), "text")
    # the hash as a number from 0 up, and the zero bits that it begins with
    d = d.withColumn("h", F.expr("h & 9223372036854775807")).withColumn("zeros", F.expr("63 - length(bin(h))"))
    levels = d.groupBy("lang", "zeros").agg(F.approx_count_distinct("h", 0.05).alias("n"))
    up = Window.partitionBy("lang").orderBy(F.desc("zeros")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # 64 rows at most of each label
    enough = levels.withColumn("upto", F.sum("n").over(up)).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= 1.3 * train_docs + 20, F.col("zeros"))), F.lit(0)).alias("least"))
    enough = stash(enough, "languages")
    if enough.count() <= broadcast_limit:
        near = d.join(F.broadcast(enough), "lang")
    else:  # the texts of one label are spread over `salts` tasks
        enough = enough.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        near = d.withColumn("salt", F.pmod(F.col("h"), F.lit(salts)).cast("int")).join(enough, ["lang", "salt"])
    few = near.filter("zeros >= least").groupBy("lang", "h").agg(F.min("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("h")
    return few.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= train_docs).select("lang", "text")


def fit(docs: DataFrame, train_docs: int = 500) -> Model:
    """Trigram tables from at most train_docs documents of each language label."""
    ship(docs.sparkSession)
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rows: pd.DataFrame = sample(docs, train_docs).mapInArrow(_fit_counts, "lang string, cells binary, scripts binary").toPandas()
    for lang, cells, script in rows.itertuples(index=False):
        c, s = np.frombuffer(cells, np.int64), np.frombuffer(script, np.int64)
        old = counts.get(lang, (0, 0))
        counts[lang] = (old[0] + c, old[1] + s)
    return Model(counts)


def spans(docs: DataFrame, model: Model | None = None, penalty: float = 12.0, train_docs: int = 500) -> DataFrame:
    """(doc_id, span, lang, first_word, n_words, char_start, char_end): the spans of every document, in order."""
    ship(docs.sparkSession)
    model = model or fit(docs, train_docs)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return d.mapInArrow(_label(model, penalty), "doc_id long, span long, lang string, first_word long, n_words long, char_start long, char_end long")
