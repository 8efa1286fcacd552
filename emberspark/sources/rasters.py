"""Array files as a Spark data source: ``spark.read.format("npy_raster")`` and ``df.write.format("npy_raster")``.

Reading.  A partition is a run of small files or one of several ranges of rows (columns,
if a file is stored column by column) of a large one, planned from file sizes alone; the
task reads the file's header and the bytes of its own range.  Filters on ``tile``,
``px_row`` and ``px_col`` are pushed down: files of other tiles, and files whose origin or
manifest entry shows that they hold none of the rows, are not opened, and of the others
only the rows asked for are read.

Writing.  Tasks write chunks of one tile below a folder of this write's own and report
them in commit messages.  Only when all tasks are done does the commit write one manifest
that names the chunks, in a single put; a reader of a folder with manifests reads what
they name and nothing else.  So a failed or repeated task leaves nothing visible, on any
file system, with no rename; its files are deleted by the abort as far as they are known.

A chunk that has each of its pixels once is a dense array.  One with gaps or repeated
pixels is a list of (row, column, values), so that a sparse raster reads back with the
pixels it had and no others.

Files are opened through ``pyarrow.fs``, which must know the store.

Defined cases: NaN values are read as NULL, NULL values are written as NaN; a row without
tile, row or column has no place in a raster and is refused; an empty write commits an
empty manifest; a folder without files has no rows.
"""

from __future__ import annotations

import fnmatch
import json
import re
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage)

from .arrays import BAND_ORDER, _chunk_origin, _header, file_system

FORMAT = "npy_raster"
#: Bytes of files in one partition, and of a range of a larger file.
PARTITION_BYTES = 64 << 20
#: Side of a chunk: 104 MB of one band.
CHUNK = 3616
BATCH_ROWS = 1 << 16
KEYS = ("tile", "px_row", "px_col")
MANIFEST = "_manifest-"


def _tile_of(name: str) -> str:
    """The tile that a file belongs to: its ``tile=`` folder, or its name without origin and ending."""
    folder = re.search(r"(?:^|/)tile=([^/]*)/", name)
    return unquote(folder.group(1)) if folder else re.sub(r"(_r\d+_c\d+)?\.[^./]+$", "", name.rsplit("/", 1)[-1])


@dataclass
class _File:
    name: str           # path in the store
    size: int
    tile: str
    rows: tuple | None  # first and last row + 1, where known without opening it
    cols: tuple | None


def _files(path: str, pattern: str) -> list[_File]:
    from pyarrow import fs

    store, top = file_system(path)
    info = store.get_file_info(top)
    if info.type == fs.FileType.File:
        return [_File(top, info.size, _tile_of(top), None, None)]
    found = [f for f in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)) if f.is_file]
    manifests = [f for f in found if f.base_name.startswith(MANIFEST)]
    if not manifests:
        return sorted((_File(f.path, f.size, _tile_of(f.path[len(top):]), None, None) for f in found
                       if fnmatch.fnmatch(f.base_name, pattern) and f.size), key=lambda f: f.name)
    out = []
    for m in sorted(manifests, key=lambda f: f.path):
        with store.open_input_file(m.path) as fh:
            for e in json.loads(fh.read()):
                out.append(_File(f"{top.rstrip('/')}/{e['file']}", e["bytes"], e["tile"], tuple(e["rows"]), tuple(e["cols"])))
    return out


@dataclass
class _Part(InputPartition):
    """Files and, for each, which of how many ranges."""
    pieces: list

    def __init__(self, pieces):
        super().__init__(None)
        self.pieces = pieces


class _Bounds:
    """What pushed filters leave of tiles, rows and columns."""

    def __init__(self):
        self.tiles, self.lo, self.hi = None, {"px_row": 0, "px_col": 0}, {"px_row": None, "px_col": None}

    def take(self, f) -> bool:
        """Narrow by a filter; False if it is not of a kind that is handled here."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, IsNotNull):
            return column in KEYS
        if column == "tile" and isinstance(f, (EqualTo, In)):
            named = set(f.value) if isinstance(f, In) else {f.value}
            self.tiles = named if self.tiles is None else self.tiles & named
            return True
        if column in self.lo and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.lo[column] = max(self.lo[column], f.value + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                top = f.value + (not isinstance(f, LessThan))
                self.hi[column] = top if self.hi[column] is None else min(self.hi[column], top)
            return True
        return False

    def cut(self, column: str, first: int, end: int) -> tuple[int, int]:
        """The part of ``first..end`` that is asked for."""
        hi = self.hi[column]
        return max(first, self.lo[column]), end if hi is None else min(end, hi)

    def may_hold(self, file: _File) -> bool:
        r0, c0 = _chunk_origin(file.name)
        for column, span, first in (("px_row", file.rows, r0), ("px_col", file.cols, c0)):
            lo, hi = self.cut(column, *(span or (first, 1 << 62)))
            if lo >= hi:
                return False
        return self.tiles is None or file.tile in self.tiles


class RasterReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.path, self.pattern = options["path"], options.get("pathGlobFilter", "*.npy")
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.bands = [f.name for f in schema.fields if f.name not in KEYS]
        self.bounds = _Bounds()

    def pushFilters(self, filters):
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self):
        out, held, size = [], [], 0
        for f in _files(self.path, self.pattern):
            if not self.bounds.may_hold(f):
                continue
            if f.size > self.bytes:
                n = -(-f.size // self.bytes)
                out += [_Part([(f, k, n)]) for k in range(n)]
                continue
            if held and size + f.size > self.bytes:
                out.append(_Part(held))
                held, size = [], 0
            held.append((f, 0, 1))
            size += f.size
        return [*out, *([_Part(held)] if held else [])] or [_Part([])]

    def read(self, partition: _Part):
        store, _ = file_system(self.path)
        for file, k, n in partition.pieces:
            with store.open_input_file(file.name) as fh:
                yield from self._pieces(fh, file, k, n)

    def _pieces(self, fh, file: _File, k: int, n: int):
        shape, fortran, dtype, begin = _header(fh, file.name)
        r0, c0 = _chunk_origin(file.name)

        def values(at, count):
            fh.seek(begin + at * dtype.itemsize)
            return np.frombuffer(fh.read(count * dtype.itemsize), dtype)

        if file.name.endswith(".list.npy"):
            lo, hi = shape[0] * k // n, shape[0] * (k + 1) // n
            for at in range(lo, hi, BATCH_ROWS):
                part = values(at * shape[1], (min(at + BATCH_ROWS, hi) - at) * shape[1]).reshape(-1, shape[1])
                yield from self._batch(file, part[:, 0].astype(np.int64), part[:, 1].astype(np.int64), part[:, 2:])
            return
        h, w, planes = (*shape, 1)[:3]
        if planes != len(self.bands):
            raise ValueError(f"{file.name}: {planes} planes, {len(self.bands)} band names")
        lines, across = (w, h) if fortran else (h, w)
        line, other, first, start = ("px_col", "px_row", c0, r0) if fortran else ("px_row", "px_col", r0, c0)
        lo, hi = (x - first for x in self.bounds.cut(line, first + lines * k // n, first + lines * (k + 1) // n))
        left, right = (x - start for x in self.bounds.cut(other, start, start + across))
        step = max(1, BATCH_ROWS // max(1, across))
        for at in range(lo, hi, step) if left < right else ():
            count = min(at + step, hi) - at
            if fortran:
                block = np.stack([values((p * w + at) * h, count * h).reshape(count, h) for p in range(planes)], axis=2)
            else:
                block = values(at * w * planes, count * w * planes).reshape(count, w, planes)
            block = block[:, left:right]
            own = np.repeat(np.arange(at, at + count) + first, right - left)
            beside = np.tile(np.arange(left, right) + start, count)
            rows, cols = (beside, own) if fortran else (own, beside)
            yield from self._batch(file, rows, cols, block.reshape(-1, planes), trimmed=True)

    def _batch(self, file, rows, cols, block, trimmed=False):
        if not trimmed:
            keep = np.ones(len(rows), bool)
            for column, at in (("px_row", rows), ("px_col", cols)):
                lo, hi = self.bounds.cut(column, -(1 << 62), 1 << 62)
                keep &= (at >= lo) & (at < hi)
            rows, cols, block = rows[keep], cols[keep], block[keep]
        planes = [block[:, i].astype(np.float64) for i in range(len(self.bands))]
        arrays = [pa.array([file.tile], pa.string()).take(pa.array(np.zeros(len(rows), np.int64))), pa.array(rows, pa.int64()),
                  pa.array(cols, pa.int64()), *[pa.array(p, pa.float64(), mask=np.isnan(p)) for p in planes]]
        yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, *self.bands])


@dataclass
class _Written(WriterCommitMessage):
    files: list


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunkSize", CHUNK))
        self.bands = [f.name for f in schema.fields if f.name not in KEYS]
        self.own = uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        store, top = file_system(self.path)
        folder = f"_data-{self.own}/{uuid.uuid4().hex}"
        done: list[dict] = []
        held: list[pa.RecordBatch] = []
        last, count = None, 0

        def flush():
            nonlocal held, count
            if held:
                done.append(self._chunk(store, top, folder, len(done), last, pa.Table.from_batches(held)))
            held, count = [], 0

        try:
            for b in iterator:
                tiles, (rows, cols) = b.column("tile"), (b.column(c) for c in KEYS[1:])
                if tiles.null_count or rows.null_count or cols.null_count:
                    raise ValueError("a pixel without tile, row or column has no place in a raster")
                tiles = tiles.to_pylist()
                keys = list(zip(tiles, (rows.to_numpy() // self.chunk).tolist(), (cols.to_numpy() // self.chunk).tolist()))
                edges = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
                for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                    if lo == hi:
                        continue
                    if keys[lo] != last or count >= self.chunk ** 2:
                        flush()
                    last = keys[lo]
                    held.append(b.slice(lo, hi - lo))
                    count += hi - lo
            flush()
        except BaseException:
            for e in done:
                store.delete_file(f"{top.rstrip('/')}/{e['file']}")
            raise
        return _Written(done)

    def _chunk(self, store, top, folder, number, key, t: pa.Table) -> dict:
        rows, cols = (t.column(c).to_numpy() for c in KEYS[1:])
        planes = np.stack([t.column(b).to_numpy(zero_copy_only=False).astype(np.float64) for b in self.bands], axis=1)
        (r0, r1), (c0, c1) = (rows.min(), rows.max() + 1), (cols.min(), cols.max() + 1)
        h, w = int(r1 - r0), int(c1 - c0)
        place = (rows - r0) * w + (cols - c0)
        if len(rows) == h * w and len(np.unique(place)) == h * w:
            arr, ending = np.empty((h * w, len(self.bands))), ".npy"
            arr[place] = planes
            arr = arr.reshape(h, w, -1)
        else:
            arr, ending = np.concatenate([rows[:, None].astype(np.float64), cols[:, None].astype(np.float64), planes], axis=1), ".list.npy"
        name = f"{folder}/tile={quote(key[0], safe='')}/chunk{number}_r{r0}_c{c0}{ending}"
        full = f"{top.rstrip('/')}/{name}"
        store.create_dir(full.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(full) as out:
            np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(arr))
            out.write(np.ascontiguousarray(arr).data)
        size = store.get_file_info(full).size
        return {"file": name, "bytes": size, "tile": key[0], "rows": [int(r0), int(r1)], "cols": [int(c0), int(c1)]}

    def commit(self, messages) -> None:
        store, top = file_system(self.path)
        store.create_dir(top, recursive=True)
        files = [e for m in messages if m is not None for e in m.files]
        with store.open_output_stream(f"{top.rstrip('/')}/{MANIFEST}{self.own}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, top = file_system(self.path)
        mine = f"{top.rstrip('/')}/_data-{self.own}"
        if store.get_file_info(mine).type == fs.FileType.Directory:
            store.delete_dir(mine)


class RasterSource(DataSource):
    """``tile string, px_row long, px_col long`` and one double for each band."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        bands = [b.strip() for b in self.options.get("bands", ",".join(BAND_ORDER)).split(",")]
        return T.StructType([T.StructField("tile", T.StringType()), T.StructField("px_row", T.LongType()),
                             T.StructField("px_col", T.LongType()), *[T.StructField(b, T.DoubleType()) for b in bands]])

    def reader(self, schema):
        return RasterReader(schema, self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a raster folder is appended to; write to a new folder instead of overwriting")
        return RasterWriter(schema, self.options)


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses a source that takes filters otherwise
    spark.dataSource.register(RasterSource)


def read_rasters(spark: SparkSession, path: str, bands=BAND_ORDER, glob: str = "*.npy", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Pixel rows ``tile, px_row, px_col`` and bands of the array files below ``path``."""
    _register(spark)
    return (spark.read.format(FORMAT).option("bands", ",".join(bands)).option("pathGlobFilter", glob)
            .option("partitionBytes", str(partition_bytes)).load(path))


def write_rasters(df: DataFrame, path: str, bands, tile=None, chunk_size: int = CHUNK) -> None:
    """Append the pixels of ``df`` (``px_row``, ``px_col``, the bands and a tile column, or one tile for all) to a raster folder.

    A chunk's pixels meet in one task, which holds at most ``chunk_size`` squared of them at a time.
    """
    _register(df.sparkSession)
    name = F.lit("all") if tile is None else F.col(tile).cast("string")
    rows = df.select(name.alias("tile"), F.col("px_row").cast("long").alias("px_row"), F.col("px_col").cast("long").alias("px_col"),
                     *[F.col(b).cast("double").alias(b) for b in bands])
    chunk = [F.col("tile"), F.floor(F.col("px_row") / chunk_size), F.floor(F.col("px_col") / chunk_size)]
    (rows.repartition(*chunk).sortWithinPartitions(*chunk).write.format(FORMAT).mode("append")
     .option("chunkSize", str(chunk_size)).save(path))
