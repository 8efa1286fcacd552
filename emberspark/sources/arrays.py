"""Array files (``.npy``) as pixel rows, and pixel rows as array-file chunks.

Reading: ``binaryFile`` lists and loads each file of up to ``max_file_bytes``
(one task each), ``mapInPandas`` decodes it with NumPy and emits bounded
pandas batches of pixel rows -- the only Python-worker code on the read path,
and it only decodes; all scoring happens afterwards in JVM expressions.
Of a larger ``.npy`` file only the header is read first; it is dealt out as
ranges of rows (of columns, if it is stored column by column) of about
``RANGE_BYTES``, and each task reads the bytes of its own range through
``pyarrow.fs``.  No file size is refused.

Writing: pixels are grouped by chunk key and each group (bounded by the
chunk size, chunk keys are unique per pixel) is turned into one ``.npy``
chunk by ``applyInPandas``.
"""

from __future__ import annotations

import io
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BAND_ORDER = ("b04", "b08", "b11", "b12")   # band planes of a (h, w, 4) cube, in order
MAX_FILE_BYTES = 512 * 1024 * 1024   # larger files are read in ranges
RANGE_BYTES = 64 * 1024 * 1024
ROWS_PER_BATCH = 1 << 16


def npy_schema(bands=BAND_ORDER) -> T.StructType:
    return T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("row_offset", T.LongType()),
        T.StructField("col_offset", T.LongType()),
        T.StructField("px_row", T.LongType()),
        T.StructField("px_col", T.IntegerType()),
        *[T.StructField(b, T.DoubleType()) for b in bands],
    ])


_ORIGIN = re.compile(r"_r(\d+)_c(\d+)\.npy$")


def _chunk_origin(path: str) -> tuple[int, int]:
    """``..._r<row>_c<col>.npy`` names carry the chunk origin; else (0, 0)."""
    m = _ORIGIN.search(path)
    return (int(m.group(1)), int(m.group(2))) if m else (0, 0)


def npy_decoder(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)


def _pixel_frames(path, arr, names, r0, c0, row=0, col=0):
    """Bounded pandas batches of a (h, w) or (h, w, bands) block that begins at (row, col) of its file."""
    if arr.ndim == 2:
        arr = arr[:, :, None]
    if arr.ndim != 3:
        raise ValueError(f"{path}: expected a (h, w) or (h, w, bands) array, got {arr.shape}")
    h, w, nb = arr.shape
    if nb != len(names):
        raise ValueError(f"{path}: {nb} planes, {len(names)} band names")
    flat = arr.reshape(h * w, nb)
    for start in range(0, h * w, ROWS_PER_BATCH):
        at = np.arange(start, min(start + ROWS_PER_BATCH, h * w), dtype=np.int64)
        own = flat[start:start + ROWS_PER_BATCH].astype(np.float64)
        out = {"path": path, "row_offset": r0, "col_offset": c0,
               "px_row": at // w + (r0 + row), "px_col": (at % w + (c0 + col)).astype(np.int32)}
        for i, name in enumerate(names):
            out[name] = own[:, i]
        yield pd.DataFrame(out)


def _decode(bands, decoder=npy_decoder):
    names = list(bands)

    def fn(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                if content is not None:
                    yield from _pixel_frames(path, decoder(content), names, *_chunk_origin(path))
    return fn


def file_system(path: str):
    """The store of a path or URI, opened by ``pyarrow.fs``, and the path in it."""
    from urllib.parse import unquote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[len("file:"):]).lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    store, name = file_system(path)
    return store.open_input_file(name)


def _header(fh, path: str):
    """Shape, whether columns lie together, type and the first byte of the values of an ``.npy`` file."""
    version = np.lib.format.read_magic(fh)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(fh)
    if dtype.hasobject:
        raise ValueError(f"{path}: arrays of objects are not read")
    if len(shape) not in (2, 3):
        raise ValueError(f"{path}: expected a (h, w) or (h, w, bands) array, got {shape}")
    return shape, fortran, dtype, fh.tell()


def _ranges(range_bytes):
    """``path, first, last`` of each range of a file's rows (columns)."""

    def fn(batches):
        for pdf in batches:
            for path in pdf["path"]:
                with _open(path) as fh:
                    shape, fortran, dtype, _ = _header(fh, path)
                lines = shape[1] if fortran else shape[0]
                one = max(1, int(np.prod(shape, dtype=object)) * dtype.itemsize // max(1, lines))
                first = np.arange(0, lines, max(1, range_bytes // one), dtype=np.int64)
                yield pd.DataFrame({"path": path, "first": first, "last": np.append(first[1:], lines)[:len(first)]})
    return fn


def _read_range(bands):
    names = list(bands)

    def fn(batches):
        for pdf in batches:
            for path, first, last in zip(pdf["path"], pdf["first"], pdf["last"]):
                with _open(path) as fh:
                    shape, fortran, dtype, begin = _header(fh, path)
                    h, w, nb = (*shape, 1)[:3]
                    n = last - first

                    def values(at, count):
                        fh.seek(begin + at * dtype.itemsize)
                        return np.frombuffer(fh.read(count * dtype.itemsize), dtype)

                    if fortran:
                        arr = np.stack([values((k * w + first) * h, n * h).reshape(n, h).T for k in range(nb)], axis=2)
                    else:
                        arr = values(first * w * nb, n * w * nb).reshape(n, w, nb)
                yield from _pixel_frames(path, arr, names, *_chunk_origin(path), *((0, first) if fortran else (first, 0)))
    return fn


def _decode_whole(bands, decoder):
    names = list(bands)

    def fn(batches):
        for pdf in batches:
            for path in pdf["path"]:
                with _open(path) as fh:
                    arr = decoder(fh.read())
                yield from _pixel_frames(path, arr, names, *_chunk_origin(path))
    return fn


def read_npy(spark: SparkSession, path: str, bands=BAND_ORDER, glob: str = "*.npy",
             max_file_bytes: int = MAX_FILE_BYTES, decoder=npy_decoder, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pixel rows from array files under ``path``; NaN planes become NULL.

    ``decoder`` turns a file's bytes into a ``(h, w)`` or ``(h, w, bands)``
    array (default: ``.npy``); any raster codec available on the executors
    plugs in here with the same distribution (one file per task). Files above
    ``max_file_bytes`` are read in ranges of about ``range_bytes``; those of
    another codec, which only it can divide, whole by one task.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    schema = npy_schema(bands)
    rows = files.where(F.col("length") <= max_file_bytes).select("path", "content").mapInPandas(_decode(bands, decoder), schema)
    large = files.where(F.col("length") > max_file_bytes).select("path", "length")
    size = large.agg(F.sum("length")).first()[0]
    if size:
        tasks = -(-size // range_bytes)
        if decoder is npy_decoder:
            parts = large.select("path").mapInPandas(_ranges(range_bytes), "path string, first long, last long")
            more = parts.repartition(tasks).mapInPandas(_read_range(bands), schema)
        else:
            more = large.select("path").mapInPandas(_decode_whole(bands, decoder), schema)
        rows = rows.unionByName(more)
    return rows.withColumns({b: F.when(~F.isnan(b), F.col(b)) for b in bands})


def tile_catalogue(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per tile file: path, name, size, modification time.

    The ``content`` column is not selected, so file bodies are not read.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    return files.select(
        F.col("path").alias("tile_path"),
        F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("tile_name"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"))


def write_npy_chunks(df: DataFrame, out_dir: str, chunk_size: int, value_cols: list[str],
                     row: str = "px_row", col: str = "px_col", scene: str | None = None) -> DataFrame:
    """Write a raster as ``chunk_r<row>_c<col>.npy`` files, one per chunk
    (under ``<scene>=<value>/`` folders when a scene column is given, so a
    group never mixes rasters: a group holds at most ``chunk_size**2`` pixels
    of one raster with unique (row, col)).

    Returns (lazily) one row per written chunk: path, origin and shape. Call
    an action on it to perform the write. Missing pixels are NaN.
    """
    keyed = df.select(
        (F.col(scene).cast("string") if scene else F.lit("")).alias("_scene"),
        F.floor(F.col(row) / chunk_size).cast("long").alias("chunk_y"),
        F.floor(F.col(col) / chunk_size).cast("long").alias("chunk_x"),
        F.col(row).cast("long").alias("_r"), F.col(col).cast("long").alias("_c"),
        *[F.col(v).cast("double").alias(v) for v in value_cols])
    out_schema = "path string, chunk_y long, chunk_x long, height int, width int"
    names = list(value_cols)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        cy, cx = int(pdf["chunk_y"].iloc[0]), int(pdf["chunk_x"].iloc[0])
        r0, c0 = cy * chunk_size, cx * chunk_size
        r = pdf["_r"].to_numpy() - r0
        c = pdf["_c"].to_numpy() - c0
        h, w = int(r.max()) + 1, int(c.max()) + 1
        arr = np.full((h, w, len(names)), np.nan, dtype=np.float64)
        for i, name in enumerate(names):
            arr[r, c, i] = pdf[name].to_numpy(dtype=np.float64, na_value=np.nan)
        sc = str(pdf["_scene"].iloc[0])
        store, top = file_system(out_dir)
        folder = f"{top.rstrip('/')}/{scene}={sc}" if scene else top.rstrip("/")
        store.create_dir(folder, recursive=True)
        target = f"{folder}/chunk_r{r0}_c{c0}.npy"
        tmp = f"{target}.{uuid.uuid4().hex}.tmp"
        whole = io.BytesIO()
        np.save(whole, arr)
        with store.open_output_stream(tmp) as fh:  # write-then-rename: a retried task
            fh.write(whole.getvalue())             # never leaves a torn chunk behind
        store.move(tmp, target)
        return pd.DataFrame({"path": [target], "chunk_y": [cy], "chunk_x": [cx],
                             "height": [h], "width": [w]})

    return keyed.groupBy("_scene", "chunk_y", "chunk_x").applyInPandas(write, out_schema)


def read_tile_logs(spark: SparkSession, path: str, glob: str = "batch_*.log") -> DataFrame:
    """Batch log scan: tiles processed and the ``mean risk = x`` numbers.

    Returns one row: tiles (count of ``Processing tile:`` lines), number of
    parsed scores, their average, minimum and maximum.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    v = F.col("value")
    score = F.regexp_extract(v, r"mean risk = ([\d.]+)", 1)
    parsed = lines.select(
        v.contains("Processing tile:").alias("is_tile"),
        F.when(score != "", score.cast("double")).alias("score"))
    return parsed.agg(
        F.count_if("is_tile").alias("tiles"),
        F.count("score").alias("scores"),
        F.round(F.avg("score"), 6).alias("avg_risk"),
        F.min("score").alias("min_risk"),
        F.max("score").alias("max_risk"))


def write_tile_logs(tile_means: DataFrame, batches: DataFrame, out_dir: str,
                    tile: str = "tile_id") -> None:
    """Per-batch log files with one 'Processing tile:' and one result line per
    tile, as the batch runner prints them (score with two decimals)."""
    name = F.format_string("tile_%03d", F.col(tile))
    lines = tile_means.join(batches, tile).select(
        "batch_id", tile,
        F.explode(F.array(
            F.concat(F.lit("Processing tile: "), name),
            F.concat(F.lit("Tile "), name, F.lit(" processed: mean risk = "),
                     F.format_string("%.2f", F.col("tile_mean_risk"))))).alias("value"))
    (lines.repartition("batch_id").sortWithinPartitions(tile, F.col("value").desc())
          .select("batch_id", "value")
          .write.mode("overwrite").partitionBy("batch_id").text(out_dir))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (a URI where that is one)."""
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

