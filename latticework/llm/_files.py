"""Files of the shared folder, read and written inside of tasks through Arrow's file systems."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as afs


def resolve(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def read_table(path: str, columns: list[str] | None = None) -> pa.Table:
    """A folder of Parquet files as Spark writes it."""
    fs, at = resolve(path)
    files = sorted(x.path for x in fs.get_file_info(afs.FileSelector(at, allow_not_found=True)) if x.path.endswith(".parquet"))
    if not files:
        return pa.table({})
    return pa.concat_tables([pq.read_table(f, filesystem=fs, columns=columns, partitioning=None) for f in files])


def write_file(path: str, table: pa.Table) -> None:
    fs, at = resolve(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    pq.write_table(table, at, filesystem=fs, compression="zstd")


def read_file(path: str) -> pa.Table:
    fs, at = resolve(path)
    return pq.read_table(at, filesystem=fs, partitioning=None)


def save_array(path: str, array: np.ndarray) -> None:
    fs, at = resolve(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    data = io.BytesIO()
    np.save(data, array)
    with fs.open_output_stream(at) as out:
        out.write(data.getbuffer())


def load_array(path: str) -> np.ndarray:
    """Mapped where the file system is local, else read."""
    fs, at = resolve(path)
    if isinstance(fs, afs.LocalFileSystem):
        return np.load(at, mmap_mode="r")
    with fs.open_input_stream(at) as f:
        return np.load(io.BytesIO(f.read()))


__all__ = ["load_array", "read_file", "read_table", "resolve", "save_array", "write_file"]
