"""Arrays and Parquet files of the shared folder, read and written inside of tasks through Arrow's file systems."""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as afs


def _at(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def parts(path: str) -> list[str]:
    """The Parquet files of a folder, in the order of Spark's partitions."""
    fs, at = _at(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    found = sorted(x.path for x in fs.get_file_info(afs.FileSelector(at, allow_not_found=True)) if x.path.endswith(".parquet"))
    return [f"{scheme if isinstance(fs, afs.LocalFileSystem) or '://' not in path else path[: path.index(at)]}{x}" for x in found]


def read(path: str, columns: list[str] | None = None) -> pa.Table:
    """A Parquet file, or all of a folder."""
    files = [path] if path.endswith(".parquet") else parts(path)
    tables = [pq.read_table(at, filesystem=fs, columns=columns, partitioning=None) for fs, at in map(_at, files)]
    return pa.concat_tables(tables) if tables else pa.table({})


def save(path: str, array: np.ndarray) -> None:
    fs, at = _at(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    data = io.BytesIO()
    np.save(data, array)
    with fs.open_output_stream(at) as out:
        out.write(data.getbuffer())


def stream(path: str, kind: type, n: int, parts: Iterable[np.ndarray]) -> None:
    """An array of n values, written a part at a time."""
    fs, at = _at(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(np.dtype(kind)), "fortran_order": False, "shape": (n,)})
    with fs.open_output_stream(at) as out:
        out.write(head.getvalue())
        for x in parts:
            out.write(np.ascontiguousarray(x, kind).tobytes())


def load(path: str) -> np.ndarray:
    """Mapped where the file system is local, else read."""
    fs, at = _at(path)
    if isinstance(fs, afs.LocalFileSystem):
        return np.load(at, mmap_mode="r")
    with fs.open_input_stream(at) as f:
        return np.load(io.BytesIO(f.read()))


def rows(path: str) -> list[int]:
    """How many rows each file of a folder has, in their order."""
    return sizes(parts(path))


def sizes(files: list[str]) -> list[int]:
    return [pq.read_metadata(at, filesystem=fs).num_rows for fs, at in map(_at, files)]


def names(path: str) -> pa.Array:
    """A column of strings that stream_names wrote, mapped where the file system is local."""
    fs, at = _at(path)
    source = pa.memory_map(at) if isinstance(fs, afs.LocalFileSystem) else fs.open_input_file(at)
    t = pa.ipc.open_file(source).read_all().column(0)
    return t.chunk(0) if t.num_chunks == 1 else t.combine_chunks()


def stream_names(path: str, column: pa.ChunkedArray) -> None:
    fs, at = _at(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    t = pa.table({"node": column.cast(pa.large_string()).combine_chunks()})
    with fs.open_output_stream(at) as out, pa.ipc.new_file(out, t.schema) as w:
        w.write_table(t)


def write(path: str, table: pa.Table) -> None:
    fs, at = _at(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    pq.write_table(table, at, filesystem=fs)
