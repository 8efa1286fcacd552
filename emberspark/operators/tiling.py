"""Chunk and strip keys (raster partitioning as plain columns).

A pixel-wise operator needs no halo, so chunking is only a clustering /
partition key: results never depend on the chunk size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_keys(px_row: str = "px_row", px_col: str = "px_col", size: int = 1024) -> dict[str, Column]:
    """``chunk_y, chunk_x`` of a ceil-division grid of ``size`` x ``size`` chunks."""
    return {
        "chunk_y": F.floor(F.col(px_row) / F.lit(size)).cast("int"),
        "chunk_x": F.floor(F.col(px_col) / F.lit(size)).cast("int"),
    }


def chunk_bounds(height, width, size: int) -> dict[str, Column]:
    """Half-open bounds of a chunk; the last row/column of chunks is ragged."""
    cy, cx = F.col("chunk_y"), F.col("chunk_x")
    return {
        "y_start": cy * size,
        "y_end": F.least((cy + 1) * size, height),
        "x_start": cx * size,
        "x_end": F.least((cx + 1) * size, width),
    }


def strip_key(px_row, height, n_workers: int) -> Column:
    """Worker ``i`` gets ``height // n`` rows, the last one the remainder (all
    rows when ``n > height``)."""
    per = F.floor(height / F.lit(n_workers))
    row = F.col(px_row) if isinstance(px_row, str) else px_row
    return F.when(per > 0, F.least(F.floor(row / per), F.lit(n_workers - 1))).otherwise(
        F.lit(n_workers - 1)).cast("int")
