"""Operator 6, token counts with overlap resynchronisation.

A text of up to `chunk` characters is encoded whole. A longer one is cut into
chunks that overlap by `overlap` characters, which are spread over the cluster
and encoded with the byte offset of every token. Two neighbours are spliced at a
position of their overlap where both have a token boundary and which is proven
stable: a character other than white space followed by white space. No piece of
the pre-tokenisation pattern holds white space after another character, so every
scan ends a piece there, wherever it began; and byte-pair merges never cross
pieces. From such a position on, the right chunk's tokens are those of the whole
text, and up to it the left chunk's are. Where an overlap has none, the document
is tried again with overlaps and chunks twice as long, until one chunk holds it.
The counts thus equal those of encoding the whole text, which the tests check.

Defined results: a null or empty text has 0 tokens and 0 characters in 1 chunk.
Strings that look like special tokens count as ordinary text. Repeated rows are
counted one by one; an empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm._arrow import slices
from latticework.session import ship, stash

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STABLE = re.compile(r"(?<=\S)(?=[ \n\r\t])")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a vocabulary file of ranks, and the bytes of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def cuts(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Where the chunks of n characters start and end."""
    if n <= chunk:
        return [(0, n)]
    step = chunk - overlap
    return [(a, min(a + chunk, n)) for a in range(0, n - overlap, step)]


def stable(overlap: str) -> list[int]:
    """Stable positions in an overlap, in bytes from its start."""
    out, chars, size = [], 0, 0
    for m in _STABLE.finditer(overlap):
        size += len(overlap[chars : m.start()].encode("utf-8", "replace"))
        chars = m.start()
        out.append(size)
    return out


def encode_chunk(text: str, left: int, right: int, path: str) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Number of tokens of a chunk; stable boundaries and tokens before them in the overlaps with its neighbours.

    left, right: characters shared with them. Positions are bytes from the
    start of the overlap.
    """
    enc, sizes = encoding(path)
    tokens = enc.encode_ordinary(text)
    ends = np.cumsum(sizes[np.asarray(tokens, np.int64)]) if tokens else np.zeros(0, np.int64)
    out: list = [len(tokens)]
    for shared, at in ((text[:left], 0), (text[len(text) - right :] if right else "", len(text[: len(text) - right].encode("utf-8", "replace")))):
        spots = np.asarray(stable(shared), np.int64)
        k = np.searchsorted(ends, spots + at)
        hit = (k < len(ends)) & (ends[np.minimum(k, len(ends) - 1)] == spots + at) if len(ends) else np.zeros(len(spots), bool)
        out += [spots[hit].tolist(), (k[hit] + 1).tolist()]
    return tuple(out)


def splice(chunks: list[tuple]) -> int | None:
    """Tokens of a text from its chunks in order, or None if an overlap has no common stable boundary."""
    total, skip = 0, 0
    for a, b in zip(chunks, chunks[1:]):
        left, right = dict(zip(a[3], a[4])), dict(zip(b[1], b[2]))
        common = sorted(left.keys() & right.keys())
        if not common:
            return None
        at = common[len(common) // 2]
        total += left[at] - skip
        skip = right[at]
    return total + chunks[-1][0] - skip


def count_text(text: str, path: str, chunk: int = 32768, overlap: int = 512) -> tuple[int, int]:
    """Tokens and chunks of one text, by the same steps as `count`."""
    while True:
        spans = cuts(len(text), chunk, overlap)
        parts = [encode_chunk(text[a:b], spans[i - 1][1] - a if i else 0, b - spans[i + 1][0] if i + 1 < len(spans) else 0, path) for i, (a, b) in enumerate(spans)]
        n = splice(parts)
        if n is not None:
            return n, len(spans)
        chunk, overlap = 2 * chunk, 2 * overlap


def _small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoding(path)
        for b in slices(batches, "text"):
            texts = [x or "" for x in b.column("text").to_pylist()]
            counts = [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([1] * len(texts), pa.int64())],
                ["doc_id", "n_tokens", "n_chars", "n_chunks"],
            )

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for uid, doc, text in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "text"))):
                spans = cuts(len(text), chunk, overlap)
                n = len(spans)
                yield pa.RecordBatch.from_pydict(
                    {
                        "uid": [uid] * n,
                        "doc_id": pa.array([doc] * n, pa.int64()),
                        "n_chars": [len(text)] * n,
                        "k": pa.array(range(n), pa.int32()),
                        "n_chunks": [n] * n,
                        "text": [text[a:z] for a, z in spans],
                        "left": pa.array([spans[i - 1][1] - spans[i][0] if i else 0 for i in range(n)], pa.int32()),
                        "right": pa.array([spans[i][1] - spans[i + 1][0] if i + 1 < n else 0 for i in range(n)], pa.int32()),
                    }
                )

    return run


def _encode(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [encode_chunk(t, a, b, path) for t, a, b in zip(f["text"], f["left"], f["right"])]
            f = f.drop(columns=["text", "left", "right"])
            for i, c in enumerate(("tokens", "left_at", "left_n", "right_at", "right_n")):
                f[c] = [x[i] for x in got]
            yield f

    return run


def _splice(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("k")
    n = splice(list(zip(f["tokens"], f["left_at"], f["left_n"], f["right_at"], f["right_n"])))
    return pd.DataFrame({"uid": f["uid"][:1], "doc_id": f["doc_id"][:1], "n_tokens": pd.array([n], "Int64"), "n_chars": f["n_chars"][:1], "n_chunks": f["n_chunks"][:1]})


def count(docs: DataFrame, path: str, chunk: int = 32768, overlap: int = 512) -> DataFrame:
    """(doc_id, n_tokens, n_chars, n_chunks) for every document. path: a vocabulary file of ranks."""
    spark = docs.sparkSession
    ship(spark)
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and shorter than a chunk")
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = "doc_id long, n_tokens long, n_chars long, n_chunks long"
    whole = d.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(_small(path), out)
    # stashed, as ids hold for one run of a plan only
    huge = stash(d.filter(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id()), "tokens-huge")
    done = []
    while True:
        pieces = huge.mapInArrow(_cut(chunk, overlap), "uid long, doc_id long, n_chars long, k int, n_chunks long, text string, left int, right int")
        coded = pieces.repartition("uid", "k").mapInPandas(
            _encode(path), "uid long, doc_id long, n_chars long, k int, n_chunks long, tokens long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"
        )
        got = stash(coded.groupBy("uid").applyInPandas(_splice, "uid long, doc_id long, n_tokens long, n_chars long, n_chunks long"), "tokens")
        done.append(got.filter("n_tokens is not null").drop("uid"))
        failed = got.filter("n_tokens is null").select("uid")
        if failed.isEmpty():
            break
        huge = stash(huge.join(failed, "uid", "left_semi"), "tokens-again")
        chunk, overlap = 2 * chunk, 2 * overlap
    for x in done:
        whole = whole.unionByName(x)
    return whole
