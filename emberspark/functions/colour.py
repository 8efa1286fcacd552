"""Colour feeds for map layers: hex parsing, class RGBA, score palette buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import clip, col
from .scores import category_colour


def hex_channel(hex_colour, i: int) -> Column:
    """Channel ``i`` (0 red, 1 green, 2 blue) of ``#RRGGBB`` as 0-255 INT."""
    h = F.regexp_replace(col(hex_colour), "^#", "")
    return F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")


def hex_rgb(hex_colour) -> dict[str, Column]:
    return {"r": hex_channel(hex_colour, 0), "g": hex_channel(hex_colour, 1),
            "b": hex_channel(hex_colour, 2)}


def category_rgba(code) -> dict[str, Column]:
    """Class code -> RGBA; class 0 (no data) is transparent black."""
    c = col(code)
    hexc = category_colour(c)
    valid = hexc.isNotNull()
    out = {k: F.when(valid, v).otherwise(F.lit(0)) for k, v in hex_rgb(hexc).items()}
    out["a"] = F.when(valid, F.lit(255)).otherwise(F.lit(0))
    return out


def palette_bucket(score, vmin: float, vmax: float, steps: int = 256) -> Column:
    """Normalise to [0, 1] by ``vmin..vmax``, clip, then ``floor(x * steps)``
    capped at ``steps - 1`` (a colour map lookup table of ``steps`` entries).
    NULL stays NULL (drawn transparent)."""
    s = col(score)
    norm = clip((s - F.lit(float(vmin))) / F.lit(float(vmax - vmin)), 0.0, 1.0)
    # least() skips NULL arguments: guard so no-data stays NULL, not the top step.
    return F.when(s.isNotNull(), F.least(F.floor(norm * F.lit(float(steps))), F.lit(steps - 1)).cast("int"))


def ramp_rgb(bucket, steps: int = 256) -> dict[str, Column]:
    """The default palette rule (see ``schema.palette_rows``) as expressions."""
    last = steps - 1
    b = col(bucket)
    return {
        "r": F.when(b.isNotNull(), F.lit(255)),
        "g": F.lit(230) - F.floor(F.lit(210) * b / F.lit(last)).cast("int"),
        "b": F.floor(F.lit(60) * (F.lit(last) - b) / F.lit(last)).cast("int"),
    }


def apply_palette(df, bucket: str, palette, prefix: str = ""):
    """Colour ``bucket`` with a palette supplied as data (``bucket, r, g, b``
    rows, e.g. ``schema.palette_dim`` or any colour map exported to a table).
    The palette has a fixed number of steps, so broadcasting it is safe; NULL
    buckets (no data) get alpha 0."""
    pal = palette.select(F.col("bucket").alias(bucket), *[F.col(c).alias(prefix + c) for c in ("r", "g", "b")])
    out = df.join(F.broadcast(pal), bucket, "left")
    return out.withColumn(prefix + "a", F.when(F.col(bucket).isNull(), F.lit(0)).otherwise(F.lit(255)))
