"""A Spark data source "vectortable": collections of documents with vectors, written by upsert.

options: path (a folder that executors reach), collection, buckets, and ids (a JSON
list), which reads those rows alone, from their buckets alone. Each commit
adds part files, of one bucket of ids each, and a list of them; of rows with one
id the last commit's wins. A collection keeps the number of buckets with which it
was made, `buckets` or 16, which is how many tasks read it. Commits of several
writers at once have names of their own and take effect in the order of their
times.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from latticework.operators.store import VectorStore
from latticework.session import ship

SCHEMA = "id string, text string, vector array<float>"
_ARROW = pa.schema([("id", pa.string()), ("text", pa.string()), ("vector", pa.list_(pa.float32()))])


def _open(options: dict) -> tuple[afs.FileSystem, str]:
    path = options["path"]
    fs, at = afs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs, f"{at}/{options.get('collection', 'default')}"


def _json(fs: afs.FileSystem, path: str) -> dict:
    with fs.open_input_stream(path) as s:
        return json.loads(s.read())


def _commits(fs: afs.FileSystem, at: str) -> list[list[str]]:
    files = sorted(f.path for f in fs.get_file_info(afs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".json") and not f.path.endswith("/facts.json"))
    return [_json(fs, f)["parts"] for f in files]


def _buckets(fs: afs.FileSystem, at: str, options: dict) -> int:
    facts = f"{at}/facts.json"
    if fs.get_file_info(facts).type == afs.FileType.File:
        return int(_json(fs, facts)["buckets"])
    return int(options.get("buckets", 16))


def _bucket(id_: str, buckets: int) -> int:
    return zlib.crc32(id_.encode("utf-8", "replace")) % buckets


@dataclass
class _Part(InputPartition):
    bucket: int
    ids: tuple[str, ...] | None


@dataclass
class _Written(WriterCommitMessage):
    parts: list[str]


class VectorTable(DataSource):
    """spark.dataSource.register(VectorTable), then format("vectortable")."""

    @classmethod
    def name(cls) -> str:
        return "vectortable"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.ids: tuple[str, ...] | None = tuple(json.loads(options["ids"])) if options.get("ids") else None

    def partitions(self) -> list[InputPartition]:
        n = _buckets(*_open(self.options), self.options)
        if self.ids is None:
            return [_Part(i, None) for i in range(n)]
        return [_Part(b, self.ids) for b in sorted({_bucket(x, n) for x in self.ids})] or [_Part(0, ())]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        """Files carry their bucket; the last commit is read first, and later ones without the ids seen so far."""
        fs, at = _open(self.options)
        seen: pa.Array = pa.array([], pa.string())
        for parts in reversed(_commits(fs, at)):
            tables = [pq.read_table(f"{at}/{p}", filesystem=fs, schema=_ARROW) for p in parts if p.startswith(f"b{partition.bucket:05d}-")]
            if not tables:
                continue
            t = pa.concat_tables(tables)
            if partition.ids is not None:
                t = t.filter(pc.is_in(t.column("id"), value_set=pa.array(partition.ids, pa.string())))
            # of one commit's rows with an id the last
            last = pa.table({"id": t.column("id"), "at": pa.array(range(len(t)), pa.int64())}).group_by("id").aggregate([("at", "max")]).column("at_max")
            t = t.take(last.combine_chunks().sort())
            t = t.filter(pc.invert(pc.is_in(t.column("id"), value_set=seen)))
            seen = pa.chunked_array([seen, *t.column("id").chunks], pa.string()).combine_chunks()
            yield from t.to_batches()


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        fs, at = _open(options)
        self.buckets = int(options.get("buckets", 16)) if overwrite else _buckets(fs, at, options)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, at = _open(self.options)
        fs.create_dir(at, recursive=True)
        size = int(self.options.get("batchSize", 256 * 16))
        held: dict[int, list[dict]] = {}
        made: list[str] = []

        def flush(b: int) -> None:
            name = f"b{b:05d}-{uuid.uuid4().hex}.parquet"
            pq.write_table(pa.Table.from_pylist(held.pop(b), schema=_ARROW), f"{at}/{name}", filesystem=fs)
            made.append(name)

        for row in iterator:
            b = _bucket(row["id"], self.buckets)
            held.setdefault(b, []).append({"id": row["id"], "text": row["text"], "vector": row["vector"]})
            if len(held[b]) >= size:
                flush(b)
        for b in list(held):
            flush(b)
        return _Written(made)

    def commit(self, messages: list) -> None:
        fs, at = _open(self.options)
        fs.create_dir(at, recursive=True)
        old = [f.path for f in fs.get_file_info(afs.FileSelector(at)) if f.type == afs.FileType.File] if self.overwrite else []
        made = [p for m in messages if m for p in m.parts]
        if self.overwrite or fs.get_file_info(f"{at}/facts.json").type != afs.FileType.File:
            with fs.open_output_stream(f"{at}/facts.json") as s:
                s.write(json.dumps({"buckets": self.buckets}).encode())
        with fs.open_output_stream(f"{at}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json") as s:
            s.write(json.dumps({"parts": made}).encode())
        for f in old:  # lists first, so that no reader finds one without its parts
            if f.endswith(".json") and not f.endswith("/facts.json"):
                fs.delete_file(f)
        for f in old:
            if f.endswith(".parquet") and f.rpartition("/")[2] not in made:
                fs.delete_file(f)

    def abort(self, messages: list) -> None:
        fs, at = _open(self.options)
        for m in messages:
            for p in m.parts if m else []:
                fs.delete_file(f"{at}/{p}")


class Collection:
    """A named collection with the methods of a vector database; made where there is none. distances: search tells 1 - similarity as well."""

    def __init__(self, spark: SparkSession, path: str, name: str = "default", embed: Callable[[Column], Column] | None = None, buckets: int = 16, distances: bool = False) -> None:
        spark.dataSource.register(VectorTable)
        ship(spark)
        self.spark, self.options, self.embed, self.distances = spark, {"path": path, "collection": name, "buckets": str(buckets)}, embed, distances
        self._store: VectorStore | None = None

    @classmethod
    def from_documents(cls, docs: DataFrame, path: str, name: str = "default", **how) -> Collection:
        """A collection with docs(id, text[, vector]) in it."""
        out = cls(docs.sparkSession, path, name, **how)
        out.upsert(docs)
        return out

    def upsert(self, docs: DataFrame) -> None:
        """Rows replace those with the same id; missing vectors are embedded."""
        if "vector" not in docs.columns and self.embed is None:
            raise ValueError("documents without a vector; give an embedder")
        have = F.col("vector").cast("array<float>") if "vector" in docs.columns else F.lit(None).cast("array<float>")
        vector = F.coalesce(have, self.embed(F.col("text")).cast("array<float>")) if self.embed else have
        docs.select(F.col("id").cast("string").alias("id"), "text", vector.alias("vector")).write.format("vectortable").options(**self.options).mode("append").save()
        self._store = None

    @property
    def docs(self) -> DataFrame:
        return self.spark.read.format("vectortable").options(**self.options).load()

    @property
    def store(self) -> VectorStore:
        """The rows as they are now, for searches and the planner."""
        if self._store is None:
            self._store = VectorStore(self.docs, check=False)
        return self._store

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """queries(qid, vector): (qid, id, similarity, rank[, distance])."""
        found = self.store.search(queries, top_k)
        return found.withColumn("distance", 1 - F.col("similarity")) if self.distances else found

    def get(self, doc_id: str) -> DataFrame:
        """One document, from its bucket alone; KeyError if there is none."""
        got = self.spark.read.format("vectortable").options(**self.options, ids=json.dumps([doc_id])).load()
        if got.isEmpty():
            raise KeyError(doc_id)
        return got

    def get_many(self, ids: list[str]) -> DataFrame:
        return self.store.get_many(ids)

    def neighbors(self, doc_id: str, k: int = 10) -> DataFrame:
        return self.store.neighbors(self.docs.filter(F.col("id") == doc_id).select("id"), k)

    def all_ids(self) -> DataFrame:
        return self.docs.select("id")

    def pages(self, size: int = 1024) -> Iterator[list[str]]:
        """All ids in order, a page at a time, each a query of its own."""
        last = None
        while True:
            d = self.all_ids() if last is None else self.all_ids().filter(F.col("id") > last)
            page = [r.id for r in d.orderBy("id").limit(size).collect()]  # a page
            if page:
                yield page
            if len(page) < size:
                return
            last = page[-1]

    @property
    def dim(self) -> int:
        return self.store.dim

    def vector_of(self, ids: DataFrame) -> DataFrame:
        return self.store.vector_of(ids)
