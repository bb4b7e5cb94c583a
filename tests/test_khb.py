from __future__ import annotations

import numpy as np
import pytest

from choicekit.operators.khb import khb
from choicekit.plans import queries as q

SF = "/root/testdata/sf0.001"


def test_anchor(spark):
    df = q._khb_frame(spark, SF)
    got = khb(df, key_vars=["x1"], z_vars=["z"], stratum="sid", choice="y")
    (d,), (z,) = got.decomposition, got.z_effects
    assert np.allclose([d["total"], d["direct"], d["indirect"], z["estimate"]], [-0.879809, -1.034501, 0.154692, 0.275637], atol=1e-6)
    assert abs(got.reduced.loglik - got.full.loglik) < 1e-6 and abs(got.full.loglik + 1772.399451) < 1e-5
    assert got.success and d["conf_pct"] == pytest.approx(100 * d["indirect"] / d["total"])


def frame(spark, n, k, seed, noise=False):
    rng = np.random.default_rng(seed)
    x, c = rng.normal(size=(n, k)), rng.normal(size=(n, k))
    z = rng.normal(size=(n, k)) + (0 if noise else 0.6 * x)
    y = np.argmax(0.5 * x + (0 if noise else 0.8) * z + 0.3 * c + rng.gumbel(size=(n, k)), axis=1)
    level = np.where(z > 0.5, "high", np.where(z < -0.5, "low", "mid"))
    rows = [(s, int(i == y[s]), float(x[s, i]), float(z[s, i]), float(c[s, i]), str(level[s, i])) for s in range(n) for i in range(k)]
    return spark.createDataFrame(rows, "sid int, choice int, x double, z double, c1 double, zf string")


def test_known_mediation(spark):
    df = frame(spark, 500, 20, 1)
    got = khb(df, key_vars=["x"], z_vars=["z"], controls=["c1"], stratum="sid", cluster="sid")
    assert abs(got.decomposition[0]["indirect"] - 0.48) < 0.12 and got.reduced.n_clusters == 500
    assert 0 < got.r_squared["z"] < 1 and abs(got.reduced.loglik - got.full.loglik) < 1e-6
    factor = khb(df, key_vars=["x"], z_vars=["zf"], controls=["c1"], stratum="sid")
    assert factor.success and {e["term"] for e in factor.z_effects} == {"zflow", "zfmid"} and factor.decomposition[0]["indirect"] > 0.1
    assert abs(factor.reduced.loglik - factor.full.loglik) < 1e-6


def test_noise_mediator_and_errors(spark):
    df = frame(spark, 300, 10, 2, noise=True)
    assert abs(khb(df, key_vars=["x"], z_vars=["z"], stratum="sid").decomposition[0]["indirect"]) < 0.15
    with pytest.raises(ValueError, match="interactions"):
        khb(df, key_vars=["x"], z_vars=["z:c1"], stratum="sid")
    with pytest.raises(ValueError, match="not found"):
        khb(df, key_vars=["nope"], z_vars=["z"], stratum="sid")
    with pytest.raises(ValueError, match="exactly one"):
        khb(df.filter("choice = 0"), key_vars=["x"], z_vars=["z"], stratum="sid")
    got = khb(df.withColumn("x2", df.x * 0 + 1), key_vars=["x"], z_vars=["z"], controls=["x:c1"], stratum="sid")
    assert got.success and len(got.decomposition) == 1
