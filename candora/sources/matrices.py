"""Matrix files as tables: ``.npy`` and MAT (version 5) files, read by ranges of rows or entries.

A Python data source that Spark splits like any other: the driver reads the headers only, and every task reads its own
range of the file (for column-major storage one piece per column). Sparse matrices are read as entries, a range of the
stored entries a task. Variables that a MAT file holds compressed can't be read by range: each of them is one task.
Paths are those of :mod:`pyarrow.fs`: local and shared folders, ``s3://``, ``gs://``, ``hdfs://``.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20  # what a task reads
BATCH_BYTES = 4 << 20  # what a record batch holds

#: Fixed values of the file format: numeric types, and the element types of matrices and compressed elements.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED, MAT_SPARSE = 14, 15, 5
MAT_NUMERIC = range(6, 16)  # classes of full numeric arrays


@dataclass
class Piece:
    """A stored array: where it begins, its type and its length; ``data`` holds it if it can't be read from the file."""

    offset: int
    kind: str
    count: int
    data: bytes | None = None

    def read(self, file: BinaryIO, low: int, high: int) -> np.ndarray:
        size = np.dtype(self.kind).itemsize
        begin = self.offset + low * size
        if self.data is not None:
            return np.frombuffer(self.data[begin : begin + (high - low) * size], self.kind)
        file.seek(begin)
        return np.frombuffer(file.read((high - low) * size), self.kind)


@dataclass
class Matrix:
    """A matrix in a file: full with its values row by row or column by column, or sparse by columns."""

    name: str
    rows: int
    columns: int
    values: Piece
    by_rows: bool = True
    row_of: Piece | None = None  # sparse: row of every entry
    ends: Piece | None = None  # sparse: where each column's entries begin, and where the last ones end

    @property
    def sparse(self) -> bool:
        return self.row_of is not None


def open_file(path: str) -> BinaryIO:
    system, name = _located(path)
    return system.open_input_file(name)


def _located(path: str):
    """File system and path in it."""
    from pyarrow import fs  # starts threads: not before it is used

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[str]:
    """The file itself, or the matrix files of a folder by name."""
    from pyarrow import fs

    system, name = _located(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(name))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.File and f.extension in ("npy", "mat"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def _npy(file: BinaryIO) -> Matrix:
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(file)
    if kind.kind not in "iufb" or len(shape) not in (1, 2):
        raise ValueError("a matrix file holds numbers in one or two dimensions")
    rows, columns = shape[0], shape[1] if len(shape) == 2 else 1
    return Matrix("", rows, columns, Piece(file.tell(), kind.str, rows * columns), by_rows=not fortran or columns == 1)


def _element(file: BinaryIO, order: str) -> tuple[int, int, int, int]:
    """Type, offset and size of the data of the element at the present place, and where the next one begins."""
    at = file.tell()
    kind, size = (int(x) for x in np.frombuffer(file.read(8), f"{order}u4"))
    if kind >> 16:  # small: type and size share four bytes, the data follows in the other four
        return kind & 0xFFFF, at + 4, kind >> 16, at + 8
    return kind, at + 8, size, at + 8 + -(-size // 8) * 8


def _mat_variable(file: BinaryIO, order: str, data: bytes | None) -> Matrix | None:
    """The variable whose element's parts begin at the present place; None unless it is a real numeric matrix."""

    def part() -> Piece:
        kind, offset, size, after = _element(file, order)
        file.seek(after)
        code = f"{order}{MAT_TYPES[kind]}"
        return Piece(offset, code, size // np.dtype(code).itemsize, data)

    def whole() -> np.ndarray:
        piece, after = part(), file.tell()
        found = piece.read(file, 0, piece.count)
        file.seek(after)
        return found

    flags, shape, name = whole(), whole(), bytes(whole().astype(np.uint8))
    kind = int(flags[0]) & 0xFF
    if len(shape) != 2 or kind != MAT_SPARSE and kind not in MAT_NUMERIC:
        return None
    rows, columns = (int(x) for x in shape)
    if kind == MAT_SPARSE:
        row_of, ends, values = part(), part(), part()
        return Matrix(name.decode(), rows, columns, values, False, row_of, ends)
    return Matrix(name.decode(), rows, columns, part(), columns == 1)


def _mat(file: BinaryIO) -> Iterator[Matrix]:
    file.seek(0, 2)
    end = file.tell()
    file.seek(0)
    head = file.read(128)
    if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
        raise ValueError("no MAT file of version 5")
    order = "<" if head[126:128] == b"IM" else ">"
    while file.tell() + 8 <= end:
        kind, size = (int(x) for x in np.frombuffer(file.read(8), f"{order}u4"))
        begin = file.tell()
        if kind == MAT_COMPRESSED:
            data = zlib.decompress(file.read(size))
            found = _mat_variable(_after_tag(io.BytesIO(data)), order, data)
            file.seek(begin + size)
        else:
            found = _mat_variable(file, order, None) if kind == MAT_MATRIX else None
            file.seek(begin + -(-size // 8) * 8)
        if found:
            yield found


def _after_tag(file: BinaryIO) -> BinaryIO:
    file.seek(8)
    return file


def find_matrix(file: BinaryIO, path: str, variable: str | None) -> Matrix:
    """The file's matrix; of a MAT file the one named ``variable``, or its only one."""
    if path.endswith(".npy"):
        return _npy(file)
    found = [m for m in _mat(file) if variable in (None, m.name)]
    if len(found) != 1:
        raise ValueError(f"{path} holds {len(found)} matrices named {variable or 'anything'}; name one")
    return found[0]


@dataclass
class _Range(InputPartition):
    path: str
    first: int  # number of the file's first row among all files
    low: int
    high: int


class MatrixReader(DataSourceReader):
    """Row ranges (``layout`` rows) or ranges of stored entries (``layout`` entries) of one or several matrix files."""

    def __init__(self, path: str, variable: str | None, entries: bool, range_bytes: int):
        self.path, self.variable, self.entries, self.range_bytes = path, variable, entries, range_bytes

    def partitions(self) -> list[InputPartition]:
        parts, first = [], 0
        for path in files_of(self.path):
            with open_file(path) as file:
                matrix = find_matrix(file, path, self.variable)
            if matrix.sparse and not self.entries:
                raise ValueError("a sparse matrix is read as entries")
            total = matrix.values.count if matrix.sparse else matrix.rows
            width = 12 if matrix.sparse else max(1, matrix.columns) * np.dtype(matrix.values.kind).itemsize
            step = max(1, self.range_bytes // width) if matrix.values.data is None else max(1, total)
            parts += [_Range(path, first, low, min(total, low + step)) for low in range(0, total, step)]
            first += matrix.rows
        return parts or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with open_file(partition.path) as file:
            matrix = find_matrix(file, partition.path, self.variable)
            width = 12 if matrix.sparse else max(1, matrix.columns) * 8
            step = max(1, BATCH_BYTES // width)
            for low in range(partition.low, partition.high, step):
                high = min(partition.high, low + step)
                if matrix.sparse:
                    yield self._stored(file, matrix, partition.first, low, high)
                    continue
                dense = self._dense(file, matrix, low, high)
                rows = np.arange(low, high) + partition.first
                if self.entries:
                    at, column = np.nonzero(dense)
                    yield _entries(rows[at], column, dense[at, column])
                else:
                    ends = pa.array(np.arange(len(dense) + 1, dtype=np.int32) * matrix.columns)
                    lists = pa.ListArray.from_arrays(ends, pa.array(dense.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(rows), lists], ["row", "features"])

    def _dense(self, file: BinaryIO, matrix: Matrix, low: int, high: int) -> np.ndarray:
        if matrix.by_rows:
            return matrix.values.read(file, low * matrix.columns, high * matrix.columns).astype(float).reshape(-1, matrix.columns)
        pieces = [matrix.values.read(file, c * matrix.rows + low, c * matrix.rows + high) for c in range(matrix.columns)]
        return np.ascontiguousarray(np.stack(pieces, 1).astype(float))

    def _stored(self, file: BinaryIO, matrix: Matrix, first: int, low: int, high: int) -> pa.RecordBatch:
        ends = matrix.ends.read(file, 0, matrix.columns + 1).astype(np.int64)
        column = np.searchsorted(ends, np.arange(low, high), "right") - 1
        row = matrix.row_of.read(file, low, high).astype(np.int64) + first
        inside = column < matrix.columns  # room that is allotted but unused
        return _entries(row[inside], column[inside], matrix.values.read(file, low, high).astype(float)[inside])


def _entries(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(column.astype(np.int32)), pa.array(value)], ["row", "column", "value"])


class MatrixSource(DataSource):
    """``spark.read.format("matrix").load(path)``; options ``variable``, ``layout`` (rows or entries) and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "row long, column int, value double" if self._entries() else "row long, features array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], self.options.get("variable"), self._entries(), int(self.options.get("rangeBytes", RANGE_BYTES)))

    def _entries(self) -> bool:
        return self.options.get("layout", "rows") == "entries"


def read_matrix_file(
    spark: SparkSession, path: str, variable: str | None = None, layout: str = "rows", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``(row, features)`` of a matrix file, or of a folder of them one below the other; ``layout`` entries gives
    ``(row, column, value)`` of what isn't 0.

    Sparse matrices are gathered from their entries: rows without any are all 0.
    """
    spark.dataSource.register(MatrixSource)
    source = spark.read.format("matrix").option("rangeBytes", range_bytes)
    if variable is not None:
        source = source.option("variable", variable)
    if layout == "entries":
        return source.option("layout", "entries").load(path)
    shapes = []
    for name in files_of(path):
        with open_file(name) as file:
            matrix = find_matrix(file, name, variable)
            shapes.append((matrix.rows, matrix.columns, matrix.sparse))
    if len({c for _, c, _ in shapes}) > 1:
        raise ValueError("matrix files of one folder must have as many columns")
    if not any(s for _, _, s in shapes):
        return source.load(path)
    rows, width = sum(r for r, _, _ in shapes), shapes[0][1]
    cells = source.option("layout", "entries").load(path).groupBy("row", "column").agg(F.sum("value").alias("value"))
    filled = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_cells"))  # a row's entries
    places = F.sequence(F.lit(0), F.lit(width - 1)) if width else F.array().cast("array<int>")
    vector = F.transform(places, lambda p: F.coalesce(F.element_at("_cells", p), F.lit(0.0)))
    return spark.range(rows).withColumnRenamed("id", "row").join(filled, "row", "left").select("row", vector.alias("features"))


def write_matrix_files(df: DataFrame, path: str, order: str, column: str = "features") -> None:
    """Vectors in the order of ``order`` as ``.npy`` files, one a task; read together they are one matrix.

    A task that is run again writes the same file again. Vectors must have one length.
    """
    placed = df.select(order, F.col(column).cast("array<double>").alias("_x")).orderBy(order).drop(order)
    system, name = _located(path)
    system.create_dir(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [np.array(b.column(0).to_pylist(), float) for b in batches if b.num_rows]
        if parts:
            number = TaskContext.get().partitionId()
            system, name = _located(path)
            held = io.BytesIO()
            np.save(held, np.concatenate(parts))
            with system.open_output_stream(f"{name}/part-{number:06d}.npy") as out:
                out.write(held.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(p) for p in parts)], pa.int64())], ["rows"])

    placed.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()
