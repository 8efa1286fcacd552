"""Array files above the size that one task loads whole."""

import os

import numpy as np
import pytest

from emberspark.sources import arrays as A


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("shape", [(37, 23, 2), (50, 31)])
def test_large_files_are_read_in_ranges(spark, tmp_out, order, shape):
    rng = np.random.default_rng(3)
    arr = rng.random(shape).astype(np.float32)
    arr[5, 7] = np.nan
    name = os.path.join(tmp_out, "a b_r100_c200.npy")
    np.save(name, np.asarray(arr, order=order))
    np.save(os.path.join(tmp_out, "small_r0_c0.npy"), arr[:2, :2])
    bands = ("b04", "b08")[:arr.reshape(*shape[:2], -1).shape[2]]
    df = A.read_npy(spark, tmp_out, bands, max_file_bytes=1000, range_bytes=1500)
    got = df.where("px_row >= 100").collect()
    assert df.count() == shape[0] * shape[1] + 4 and len(got) == shape[0] * shape[1]
    assert len({(r.px_row, r.px_col) for r in got}) == len(got)
    flat = arr.reshape(*shape[:2], -1)
    for r in got:
        for i, b in enumerate(bands):
            want = float(flat[r.px_row - 100, r.px_col - 200, i])
            assert r[b] is None if np.isnan(want) else r[b] == want
        assert (r.row_offset, r.col_offset) == (100, 200)
    assert {r.path for r in got} == {r.path for r in A.tile_catalogue(spark, tmp_out, "a*").selectExpr("tile_path as path").collect()}
