"""Principal axes against a decomposition of the whole centred matrix."""

import numpy as np

from tidewell.operators import vectorsets as vs


def test_principal_axes_equal_the_decomposition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) * np.array([5, 3, 1, 0.5, 0.2, 0.1]) + 7
    x[:20] = x[20:40]  # repeated rows
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<double>")
    got = {r["vec_id"]: (r["axis1"], r["axis2"]) for r in vs.principal_axes(df, "v").collect()}
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    want = centred @ axes.T
    assert len(got) == 200
    assert np.allclose(np.array([got[i] for i in range(200)]), want, atol=1e-8)
