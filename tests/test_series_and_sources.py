from __future__ import annotations

import numpy as np

from choicekit.functions import levels
from choicekit.functions.tables import column_order
from choicekit.operators import prep
from choicekit.plans import queries as q
from choicekit.plans.series import khb_series, run_series
from choicekit.sources import tables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_series(spark, tmp_path):
    df = q.choice_sets(spark, SF).withColumn("half", F.when(F.col("sid") % 2 == 0, "even").otherwise("odd")).persist()
    specs = {"1": "y ~ x1", "2": "y ~ x1 + x2"}
    out = f"file://{tmp_path}/series"
    t = run_series(df, specs, group_col="half", subgroup_col="ls", out=out, stratum="sid", min_rows=100).collect()
    assert {(r.group, r.model) for r in t} == {(g, m) for g in ("even", "odd") for m in "12"} and {r.subgroup for r in t} == {"all", "F", "O"}
    cached = run_series(df, specs, group_col="half", subgroup_col="ls", out=out, stratum="no such column", min_rows=100)  # nothing is fitted again
    assert cached.count() == len(t)
    k = khb_series(df, {"1": "y ~ x1", "2": "y ~ x1 + x2"}, [("1", "2")], key="x1", stratum="sid").collect()
    assert len(k) == 1 and k[0].comparison == "1-2" and k[0].success


def test_sources(spark, tmp_path):
    df = tables.read_columns(spark, f"{SF}/lineitem.parquet", ["l_orderkey", "nope", "l_tax"])
    assert df.columns == ["l_orderkey", "l_tax"]
    path = f"file://{tmp_path}/t"
    assert not tables.exists(spark, path)
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert tables.resumable(spark, path, make).count() == tables.resumable(spark, path, make).count() == 3 and made == [1]
    tables.write_table(spark.range(2), f"file://{tmp_path}/c")
    assert spark.read.csv(f"file://{tmp_path}/c", header=True).count() == 2
    fit = q.fit4(spark, SF)
    tables.save_fit(spark, fit, f"file://{tmp_path}/fit")
    assert np.allclose(tables.load_fit(spark, f"file://{tmp_path}/fit").beta, fit.beta)


def test_levels_and_prep(spark):
    assert levels.relevel(["a", "b", "c"], "b") == ["b", "a", "c"] and levels.safe_name("3+") == "X3_"
    df = spark.createDataFrame([(None,), (0,), (3,), (9,)], "c int")
    assert [r[0] for r in df.select(levels.bin_counts(F.col("c"))).collect()] == [None, "0", "3+", "3+"]
    cs = q.choice_sets(spark, SF)
    assert prep.n_sets(cs, "sid") == 1473
    assert column_order(cs, ["y", "sid"]).columns[:2] == ["y", "sid"]


def test_simulate_query_has_the_default_size(spark):
    from choicekit.plans.queries import QUERIES

    df = QUERIES["simulate"](spark, "")
    assert df.count() == 5000 * 100 and df.filter("choice = 1").count() == 5000
