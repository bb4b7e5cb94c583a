from __future__ import annotations

import math
import warnings

import numpy as np
import pytest

from choicekit.fit import ClogitFit, fit_formula, fit_matrix
from choicekit.functions.tables import append_dropped, formatted, with_metadata
from choicekit.operators import design, kernel, newton
from choicekit.operators.pack import pack, rows_of
from choicekit.plans import queries as q
from choicekit.sources.simulate import simulate
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def numpy_fit(sets, p, tol=1e-10, cluster=None):
    """Newton on a list of (X, y index, offset); beta, vcov, loglik, per-set scores."""
    b = np.zeros(p)
    for _ in range(60):
        ll, g, h, scores = 0.0, np.zeros(p), np.zeros((p, p)), []
        for x, y, o in sets:
            eta = x @ b + o
            e = np.exp(eta - eta.max())
            pr = e / e.sum()
            m = pr @ x
            ll += eta[y] - eta.max() - math.log(e.sum())
            scores.append(x[y] - m)
            g += scores[-1]
            h += x.T @ (pr[:, None] * x) - np.outer(m, m)
        if abs(g).max() < tol:
            break
        b = b + np.linalg.solve(h, g)
    return b, np.linalg.inv(h), ll, np.array(scores)


def choice_frame(spark, seed, n, k, p=3):
    rng = np.random.default_rng(seed)
    rows, sets, truth = [], [], np.array([0.8, -0.5, 0.3])[:p]
    for s in range(n):
        x, o = rng.normal(size=(k, p)), rng.normal(size=k) * 0.3
        y = int(np.argmax(x @ truth + o + rng.gumbel(size=k)))
        sets.append((x, y, o))
        rows += [(s, int(s % (n // 3 + 1)), i, int(i == y), float(o[i]), *map(float, x[i])) for i in range(k)]
    return spark.createDataFrame(rows, "sid long, cid long, i int, y int, off double, " + ", ".join(f"x{j} double" for j in range(p))).repartition(5), sets


@pytest.mark.parametrize(("n", "k"), [(80, 5), (120, 2)])
def test_against_numpy(spark, n, k):
    df, sets = choice_frame(spark, n, n, k)
    fit = fit_matrix(df, ["x0", "x1", "x2"], choice="y", stratum="sid", offset="off", cluster="cid")
    b, v, ll, u = numpy_fit(sets, 3)
    assert fit.converged and fit.n_groups == n and fit.n_obs == n * k and fit.n_events == n
    assert np.allclose(fit.beta, b, atol=1e-6) and abs(fit.loglik - ll) < 1e-6 and np.allclose(fit.vcov(False), v, atol=1e-6)
    ids = np.arange(n) % (n // 3 + 1)
    c = ids.max() + 1
    per = np.array([u[ids == i].sum(axis=0) for i in range(c)])
    assert np.allclose(fit.vcov(), c / (c - 1) * (n - 1) / n * v @ per.T @ per @ v, atol=1e-7) and fit.n_clusters == c
    again = fit_matrix(df.repartition(3, "x1"), ["x0", "x1", "x2"], choice="y", stratum="sid", offset="off")
    assert np.allclose(again.beta, fit.beta, atol=1e-9)
    plain = fit_matrix(df, ["x0", "x1", "x2"], choice="y", stratum="sid")
    assert np.allclose(plain.beta, numpy_fit([(x, y, o * 0) for x, y, o in sets], 3)[0], atol=1e-6)


def test_sets_across_batches(spark):
    df, sets = choice_frame(spark, 9, 40, 11)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        fit = fit_matrix(df, ["x0", "x1", "x2"], choice="y", stratum="sid", offset="off", order_by=["i"])
    finally:
        spark.conf.set(key, kept)
    assert fit.n_groups == 40 and fit.n_obs == 440 and np.allclose(fit.beta, numpy_fit(sets, 3)[0], atol=1e-6)


def test_anchors(spark):
    df = q.choice_sets(spark, SF)
    fit = fit_formula(df, "y ~ x1 + x2 + f", stratum="sid", cluster="cid", order_by=q.KEYS[1:])
    assert np.allclose(fit.beta, [-0.911102, 0.276573, 0.464938, -0.315177], atol=1e-6)
    assert np.allclose(fit.se(False), [0.117455, 0.023437, 0.079268, 0.087513], atol=1e-6)
    assert np.allclose(fit.se(), [0.108385, 0.022818, 0.074940, 0.092597], atol=1e-6)
    assert abs(fit.loglik + 1724.364251) < 1e-5 and fit.names == ["x1", "x2", "fN", "fR"]
    off = fit_formula(df, "y ~ x1 + x2 + f", stratum="sid", offset="corr")
    assert np.allclose(off.beta, [-1.146058, 0.385175, 0.710269, -0.434132], atol=1e-6) and abs(off.loglik + 2404.801610) < 1e-5
    scaled = fit_formula(df.withColumn("x1", F.col("x1") * 50), "y ~ x1 + x2 + f", stratum="sid", scale=True)
    assert np.allclose(scaled.beta * [50, 1, 1, 1], fit.beta, atol=1e-6) and np.allclose(scaled.se() * [50, 1, 1, 1], fit.se(False), atol=1e-6)
    moved = fit_formula(df.withColumn("corr", F.col("sid") % 5 + F.lit(0.0)), "y ~ x1 + x2 + f", stratum="sid", offset="corr")
    assert np.allclose(moved.beta, fit.beta, atol=1e-6)


def test_accessors(spark):
    df, _ = choice_frame(spark, 1, 60, 4)
    fit = fit_matrix(df, ["x0", "x1", "x2"], choice="y", stratum="sid")
    assert list(fit.coef) == ["x0", "x1", "x2"] and fit.vcov().shape == (3, 3) and fit.loglik < 0 and fit.loglik_row()["df"] == 3
    ci = fit.confint(["x1"], level=0.9)
    assert len(ci) == 1 and ci[0]["5 %"] < fit.coef["x1"] < ci[0]["95 %"]
    t, e = fit.tidy(spark).collect(), fit.tidy(spark, exponentiate=True).collect()
    assert all(abs(math.exp(a.estimate) - b.estimate) < 1e-12 and a.std_error == b.std_error and b.conf_low > 0 for a, b in zip(t, e))
    assert all(0 <= r.p_value <= 1 for r in t) and "x2" in fit.summary() and "60 sets" in repr(fit)
    assert np.allclose(fit.hessian, -fit.information) and np.allclose(ClogitFit.from_json(fit.to_json()).model_vcov, fit.model_vcov)
    table = formatted(append_dropped(with_metadata(fit.tidy(spark), fit, model="m"), spark.createDataFrame([("z", "collinear")], "term string, reason string")))
    rows = table.collect()
    assert len(rows) == 4 and rows[3].dropped and rows[3].estimate is None and rows[0].n_sets == 60


def test_dropping(spark):
    df, sets = choice_frame(spark, 3, 60, 4)
    df = df.withColumns({"c": F.lit(2.0), "w": F.col("sid").cast("double"), "s": F.col("x0") + 2 * F.col("x1"), "f": F.when(F.col("i") == 0, "a").otherwise("b")})
    fit = fit_formula(df, "y ~ x0 + c + w + x1 + s + x2 + f + f:x0", stratum="sid", levels={"f": ["a", "b", "never"]})
    assert dict(fit.dropped_terms) == {"c": "zero variance", "w": "no within-set variation", "s": "collinear", "fnever": "zero variance", "fnever:x0": "zero variance"}
    assert fit.names == ["x0", "x1", "x2", "fb", "fb:x0"] and fit.terms == ["x0", "x1", "x2", "f", "f:x0"]
    with pytest.warns(UserWarning, match="more than two"):
        fit_formula(df, "y ~ x0 + x0:x1:x2", stratum="sid")
    with pytest.warns(UserWarning, match="without variance"):
        flat = fit_matrix(df.withColumn("c", F.lit(0)), ["x0", "w", "c"], choice="y", stratum="sid")
    assert flat.names == ["x0"] and dict(flat.dropped_terms) == {"w": "no within-set variation", "c": "zero variance"}
    with pytest.raises(np.linalg.LinAlgError, match="singular"):
        fit_matrix(df, ["x0", "x1", "s"], choice="y", stratum="sid")


def test_missing_and_broken(spark):
    df, sets = choice_frame(spark, 4, 60, 4)
    holes = df.withColumn("x0", F.when((F.col("i") == 3) & (F.col("y") == 0), F.lit(None)).when((F.col("i") == 2) & (F.col("y") == 0), F.lit(float("nan"))).otherwise(F.col("x0")))
    fit = fit_formula(holes, "y ~ x0 + x1", stratum="sid")
    assert fit.n_dropped_rows == holes.filter("x0 is null or isnan(x0)").count() > 0
    broken = df.withColumn("y", F.when(F.col("sid") < 5, F.lit(0)).when((F.col("sid") < 8) & (F.col("i") < 2), F.lit(1)).otherwise(F.col("y")))
    with pytest.raises(ValueError, match="order_by"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fit_formula(broken, "y ~ x0 + x1", stratum="sid")
    with pytest.warns(UserWarning, match="5 choice sets have no chosen row"):
        got = fit_formula(broken, "y ~ x0 + x1", stratum="sid", order_by=["i"])
    own = [(x[:, :2], min(y, 0) if s < 8 and y >= 2 else (0 if s < 8 else y), o * 0) for s, (x, y, o) in enumerate(sets) if s >= 5]
    own = [(x, 0 if 5 <= s < 8 else y, o) for s, (x, y, o) in zip(range(5, 60), own)]
    assert np.allclose(got.beta, numpy_fit(own, 2)[0], atol=1e-6)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        wide = fit_formula(broken, "y ~ x0 + x1", stratum="sid", order_by=["i"], compat=True)
    assert np.allclose(wide.beta, got.beta) and (np.diag(wide.information) > np.diag(got.information)).all()
    for bad, match in ((lambda: fit_formula(df, "y ~ nope", stratum="sid"), "not found"), (lambda: fit_formula(df.withColumn("y", F.lit(2)), "y ~ x0", stratum="sid"), "0 or 1"), (lambda: fit_formula(df.withColumn("x0", F.lit(None).cast("double")), "y ~ x0", stratum="sid"), "no complete cases"), (lambda: fit_matrix(df.withColumn("t", F.lit("a")), ["t"], choice="y", stratum="sid"), "not numeric"), (lambda: fit_matrix(df, ["x0"], choice="y", stratum="sid", cluster="y", order_by=["i"]).n_clusters and fit_matrix(df.withColumn("one", F.lit(1)), ["x0"], choice="y", stratum="sid", cluster="one"), "two clusters")):
        with pytest.raises(ValueError, match=match):
            bad()


def test_gradient_is_the_slope(spark):
    df, _ = choice_frame(spark, 5, 30, 4)
    packed = pack(rows_of(df, stratum="sid", y=F.col("y"), x=[F.col(f"x{j}") for j in range(3)], offset=F.col("off"), cluster=None, order_by=[]), 3).persist()
    b = np.array([0.2, -0.1, 0.4])
    ll, g, h = kernel.evaluate(packed, 3, b)
    for j in range(3):
        d = np.eye(3)[j] * 1e-5
        up, down = kernel.evaluate(packed, 3, b + d), kernel.evaluate(packed, 3, b - d)
        assert abs((up[0] - down[0]) / 2e-5 - g[j]) < 1e-5 and np.allclose((down[1] - up[1]) / 2e-5, h[j], atol=1e-4)
    tried = kernel.logliks(packed, 3, b, g, np.array([1e-3, 1e-2]))
    assert np.allclose(tried, [kernel.evaluate(packed, 3, b + s * g)[0] for s in (1e-3, 1e-2)])
    keep = kernel.MANY_TASKS
    kernel.MANY_TASKS = 1
    try:
        assert abs(kernel.evaluate(packed, 3, b)[0] - ll) < 1e-9
    finally:
        kernel.MANY_TASKS = keep
    assert kernel.evaluate(packed.limit(0), 3, b)[0] == 0


def test_design_names(spark):
    df = spark.createDataFrame([("a", "u", 1.0, True), ("b", "v", 2.0, False), ("c", "v", 3.0, True)], "f string, g string, x double, t boolean")
    from choicekit.plans.formula import parse

    own = design.build(df, parse("y ~ f + x + t + f:g + f:x + x:f + x:t"))
    assert own.names == ["fb", "fc", "x", "t", "fb:gv", "fc:gv", "fb:x", "fc:x", "x:t"]
    assert [tuple(r) for r in df.select(*own.columns).collect()][1] == (1.0, 0.0, 2.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0)


def test_recovery(spark):
    df, truth = simulate(spark, 1500, 25, cluster_ratio=1.3, seed=3)
    assert set(df.columns) >= {"choice", "strata_id", "cluster_id", "correction", "Edudiff3_raw"} and df.filter("choice = 1").count() == 1500
    fit = fit_matrix(df, list(truth), choice="choice", stratum="strata_id", offset="correction", cluster="cluster_id")
    assert fit.converged and all(abs(fit.coef[n] - b) < 3.5 * s for (n, b), s in zip(truth.items(), fit.se()))
    same = simulate(spark, 1500, 25, cluster_ratio=1.3, seed=3)[0]
    assert same.repartition(3).exceptAll(df).count() == 0


def test_many_tasks_are_evaluated_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(kernel, "MANY_TASKS", 2)
    seen = str(tmp_path / "seen")

    def add(batch):
        with open(seen, "a") as f:
            f.write(f"{batch.num_rows}\n")
        return np.array([batch.column(0).to_numpy().sum()])

    df = spark.range(0, 1000, 1, 9).selectExpr("cast(id as double) as x")
    assert kernel.task_sums(df, ["x"], 1, add)[0] == 499500
    assert sum(map(int, open(seen))) == 1000


def test_halving_and_convergence(spark, monkeypatch):
    calls = []
    real = kernel.logliks
    monkeypatch.setattr(kernel, "logliks", lambda *a, **k: calls.append(1) or real(*a, **k))
    df, _ = simulate(spark, 200, 10, use_offset=False)
    df = df.withColumn("far", 30 * F.col("n_years_same_uni"))
    terms = ["lnDist", "n_years_same_uni"]
    near = fit_matrix(df, terms, choice="choice", stratum="strata_id")
    assert not calls
    far = fit_matrix(df, terms, choice="choice", stratum="strata_id", offset="far", max_iter=100)
    assert calls and far.converged and np.allclose(far.beta + [0, 30], near.beta, atol=1e-5)
    with pytest.warns(UserWarning, match="did not converge in 1 iterations"):
        assert not fit_matrix(df, terms, choice="choice", stratum="strata_id", max_iter=1).converged


def test_solve_falls_back_and_standstill_converges(monkeypatch):
    assert np.allclose(newton._solve(np.diag([1.0, -1e-6]), np.ones(2)), [1 / (1 + 1e-4), 1 / (1e-4 - 1e-6)], rtol=1e-3)
    assert newton._solve(np.diag([1.0, -1.0]), np.ones(2)) is None
    monkeypatch.setattr(kernel, "evaluate", lambda *a, **k: (-5.0, np.ones(1), np.eye(1)))
    best = newton.maximise(None, 1, kernel.Columns(np.arange(1), None))
    assert best.converged and best.iterations == 6


def test_tasks_grow_with_the_rows_not_what_one_holds(spark, monkeypatch):
    """Choice sets and packed sets of 6,000 rows come in tasks of about 1,000, though the shuffle setting says 4; the rows and the fit are the same."""
    from choicekit import workers

    def made():
        df = q.choice_sets(spark, SF)
        packed = pack(rows_of(df, stratum="sid", y=F.col("y"), x=[F.col("x1"), F.col("x2")], offset=None, cluster=None, order_by=[]), 2)
        fit = fit_formula(df, "y ~ x1 + x2", stratum="sid")
        return df.rdd.getNumPartitions(), packed.rdd.getNumPartitions(), sorted(map(tuple, df.collect())), fit.beta, fit.loglik

    before = made()
    monkeypatch.setattr(workers, "TASK_ROWS", 1000)
    after = made()
    rows = len(before[2])
    assert max(before[:2]) <= 4 and after[0] == after[1] == -(-rows // 1000)
    assert before[2] == after[2] and np.allclose(before[3], after[3], atol=1e-9) and abs(before[4] - after[4]) < 1e-6
