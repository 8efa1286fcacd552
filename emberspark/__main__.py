"""Command line: ``python -m emberspark <job> --pixels PATH --out DIR [options]``.

Jobs (each reads a wide pixel Parquet table and writes Parquet/JSON outputs):

* ``assess``  -- full assessment: (mask) -> indices -> score -> class; writes the
  scored pixels (partitioned by date), area statistics, run summary and the
  assessment record.
* ``quick``   -- simple model on NDVI (+ NDMI when present) with classes.
* ``raster``  -- fast model per pixel, written clustered by tile and row.
* ``series``  -- per-date fast-model series and its struct-of-arrays JSON.
* ``tiles``   -- per-tile means, batch ids and the batch report.

On a cluster, submit with spark-submit; the master and resources come from it.
"""

from __future__ import annotations

import argparse

from . import schema as S
from .operators import indices as I
from .operators import quality as Q
from .plans import assessment as E
from .session import build_session
from .sources import sinks as K


def _weights(text: str | None):
    if not text:
        return None
    out = {}
    for part in text.split(","):
        k, v = part.split("=")
        out[k.strip().upper()] = float(v)
    return out


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="emberspark", description=__doc__.split("\n")[0])
    p.add_argument("job", choices=["assess", "quick", "raster", "series", "tiles"])
    p.add_argument("--pixels", required=True, help="wide pixel Parquet table (b04, b08, b11, b12, ...)")
    p.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    p.add_argument("--master", default=None, help="only for local runs, e.g. local[8]")
    p.add_argument("--no-mask", action="store_true", help="skip the SCL cloud mask")
    p.add_argument("--weights", default=None, help="calibrated weights, e.g. NDVI=0.3,NDMI=0.5,NBR=0.2")
    p.add_argument("--pixel-area", type=float, default=S.PIXEL_AREA_M2)
    p.add_argument("--batch-size", type=int, default=S.TILES_PER_BATCH)
    a = p.parse_args(argv)

    spark = build_session(a.master)
    px = spark.read.parquet(a.pixels)
    out = a.out.rstrip("/")
    if a.job == "assess":
        res = E.full_assessment(px, _weights(a.weights), cloud_mask=not a.no_mask, pixel_area_m2=a.pixel_area)
        keys = [c for c in ("tile_id", "px_row", "px_col") if c in res.scored.columns]
        if "scene_date" in res.scored.columns:
            K.write_index_table(res.scored, f"{out}/scored", ["ndvi", "ndmi", "nbr", "risk_score", "risk_category"],
                                keys=keys)
        else:
            K.write_risk_map(res.scored, f"{out}/scored", order=keys)
        K.write_report(res.area_statistics, f"{out}/area_statistics")
        K.write_report(res.summary, f"{out}/summary")
        K.write_report(res.record, f"{out}/record")
    elif a.job == "quick":
        scored = E.quick_assessment(I.add_all_indices(Q.ingest_bands(px), only=["NDVI", "NDMI"]))
        K.write_risk_map(scored, f"{out}/quick")
    elif a.job == "raster":
        K.write_risk_map(E.large_raster(px), f"{out}/risk_map")
    elif a.job == "series":
        series, arrays = E.date_series(px)
        series.orderBy("scene_date").coalesce(1).write.mode("overwrite").parquet(f"{out}/series")
        K.write_series_json(arrays, f"{out}/series_json")
    elif a.job == "tiles":
        means, batches, per_batch, overall = E.tile_batch(px, per_batch=a.batch_size)
        means.join(batches, "tile_id").write.mode("overwrite").parquet(f"{out}/tile_means")
        K.write_report(per_batch.orderBy("batch_id"), f"{out}/batch_report")
        K.write_report(overall, f"{out}/report")
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
