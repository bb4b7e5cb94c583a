"""Queries over the driver's tables, each with the statement that gives the same rows.

The fixture is a set of choices with known coefficients: a choice set per order, an alternative per line.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fit import ClogitFit, fit_formula, fit_matrix
from ..functions import levels as L
from ..functions import tables as T
from ..operators import design as D
from ..operators import diagnostics as G
from ..operators import khb as K
from ..operators import prep as P
from ..operators import validate as V
from ..operators.pack import group_bounds
from ..workers import deal
from .formula import parse
from .oracle import chain
from .series import run_series

CHOICE_SETS = """
WITH u AS (
  SELECT l_orderkey AS sid, o_custkey AS cid, l_partkey, l_suppkey, l_linenumber,
         l_discount * 10 AS x1, l_quantity / 10 AS x2, l_returnflag AS f, l_linestatus AS ls,
         -ln(count(*) OVER (PARTITION BY l_orderkey, l_linestatus) / CASE l_linestatus WHEN 'F' THEN CAST(50 AS DOUBLE) ELSE CAST(500 AS DOUBLE) END) AS corr,
         ((l_partkey * 7919 + l_suppkey * 104729 + CAST(l_linenumber AS BIGINT) * 1299709 + l_orderkey * 15485863) % 1000003 + CAST(0.5 AS DOUBLE)) / 1000003 AS uu
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey),
s AS (SELECT *, -0.8 * x1 + 0.3 * x2 + CASE f WHEN 'N' THEN 0.5 WHEN 'R' THEN -0.4 ELSE 0 END - ln(-ln(uu)) AS util FROM u)
SELECT sid, cid, l_partkey, l_suppkey, l_linenumber, x1, x2, f, ls, corr,
       CASE WHEN row_number() OVER (PARTITION BY sid ORDER BY util DESC, l_partkey, l_suppkey, l_linenumber) = 1 THEN 1 ELSE 0 END AS y
FROM s
"""
CS = f"cs AS ({CHOICE_SETS.format(lineitem='lineitem', orders='orders')})"
KEYS = ["sid", "l_partkey", "l_suppkey", "l_linenumber"]
KEY_SQL = ", ".join(KEYS)
BETA = [-0.7, 0.3]
Z95 = "1.959963984540054::DOUBLE"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join, the window and the sorts of a task are over about as many lines, however large the table."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    n = lines.count()
    return spark.sql(CHOICE_SETS, lineitem=deal(lines, n, "l_orderkey"), orders=deal(orders, n, "o_orderkey"))


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zeros."""
    return F.round(c, digits) + F.lit(0.0)


def q(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + CAST(0 AS DOUBLE)"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__.removeprefix("q_")] = f
        if sql is not None:
            ORACLE_SQL[f.__name__.removeprefix("q_")] = sql
        return f

    return register


# --- sets, cases, factors ------------------------------------------------------------------------------


@query(f"WITH {CS} SELECT sid, cid, l_partkey, l_suppkey, l_linenumber, {q('x1')} AS x1, {q('x2')} AS x2, f, ls, {q('corr', 9)} AS corr, y FROM cs")
def q_choice_sets(spark, sf_dir):
    return choice_sets(spark, sf_dir).withColumns({"x1": r("x1"), "x2": r("x2"), "corr": r("corr", 9)})


@query(f"WITH {CS} SELECT {KEY_SQL}, nullif(l_linenumber, 7) AS z FROM cs WHERE nullif(l_linenumber, 7) IS NOT NULL")
def q_complete_cases(spark, sf_dir):
    return D.complete_cases(choice_sets(spark, sf_dir).select(*KEYS, F.expr("nullif(l_linenumber, 7)").alias("z")), ["z", "sid"])


@query(f"WITH {CS}, g AS (SELECT sid, count(*) AS size FROM cs GROUP BY sid) SELECT sid, size, CAST(sum(size) OVER (ORDER BY sid) - size AS BIGINT) AS start FROM g")
def q_group_bounds(spark, sf_dir):
    return group_bounds(choice_sets(spark, sf_dir), "sid")


BROKEN = "CASE WHEN sid % 97 = 0 THEN 0 WHEN sid % 89 = 0 THEN 1 ELSE y END"


@query(f"WITH {CS}, g AS (SELECT sid, sum({BROKEN}) AS n FROM cs GROUP BY sid) SELECT count(*) AS n_sets, CAST(count(CASE WHEN n = 0 THEN 1 END) AS BIGINT) AS n_zero, CAST(count(CASE WHEN n > 1 THEN 1 END) AS BIGINT) AS n_multi FROM g")
def q_validate_sets(spark, sf_dir):
    return V.set_problems(choice_sets(spark, sf_dir).withColumn("y", F.expr(BROKEN)), "sid", "y")


@query(f"WITH {CS} SELECT f AS level, CAST(row_number() OVER (ORDER BY f) AS BIGINT) AS position FROM (SELECT DISTINCT f FROM cs) d")
def q_factor_levels(spark, sf_dir):
    found = L.distinct_levels(choice_sets(spark, sf_dir), ["f"])["f"]
    return frame(spark, list(zip(found, range(1, len(found) + 1))), "level string, position long")


def design(formula: str, levels: dict | None = None) -> Callable:
    def make(spark, sf_dir):
        df = choice_sets(spark, sf_dir)
        own = D.build(df, parse(formula), levels)
        return df.select(*KEYS, *(r(c).alias(n.replace(":", "_")) for n, c in zip(own.names, own.columns)))

    return make


def is_(v: str, c: str = "f") -> str:
    return f"CAST({c} = '{v}' AS INTEGER)"


for _name, _formula, _sql in (
    ("dummies", "y ~ f", {"fN": is_("N"), "fR": is_("R")}),
    ("inter_ff", "y ~ f:ls", {"fN_lsO": f"{is_('N')} * {is_('O', 'ls')}", "fR_lsO": f"{is_('R')} * {is_('O', 'ls')}"}),
    ("inter_fn", "y ~ f:x1", {"fN_x1": f"{is_('N')} * x1", "fR_x1": f"{is_('R')} * x1"}),
    ("inter_nf", "y ~ x1:f", {"x1_fN": f"{is_('N')} * x1", "x1_fR": f"{is_('R')} * x1"}),
    ("inter_nn", "y ~ x1:x2", {"x1_x2": "x1 * x2"}),
):
    QUERIES[_name] = design(_formula)
    ORACLE_SQL[_name] = f"WITH {CS} SELECT {KEY_SQL}, " + ", ".join(f"{q(f'CAST({e} AS DOUBLE)')} AS {n}" for n, e in _sql.items()) + " FROM cs"

QUERIES["relevel"] = lambda spark, sf_dir: design("y ~ f", {"f": L.relevel(["A", "N", "R"], "N")})(spark, sf_dir)
ORACLE_SQL["relevel"] = f"WITH {CS} SELECT {KEY_SQL}, CAST({is_('A')} AS DOUBLE) AS fA, CAST({is_('R')} AS DOUBLE) AS fR FROM cs"


# --- columns -------------------------------------------------------------------------------------------


@query(f"WITH {CS} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {q(f'var_samp({e})')} AS variance FROM cs" for n, e in (("x1", "x1"), ("x2", "x2"), ("fN", is_("N")), ("fR", is_("R")))))
def q_column_variance(spark, sf_dir):
    df = choice_sets(spark, sf_dir)
    own = D.build(df, parse("y ~ x1 + x2 + f"))
    return V.column_variances(df, own.names, own.columns).withColumn("variance", r("variance"))


@query("SELECT 'c0' AS term, 'zero variance' AS reason UNION ALL SELECT 'w', 'no within-set variation' UNION ALL SELECT 'x3', 'collinear'")
def q_dropped_terms(spark, sf_dir):
    df = choice_sets(spark, sf_dir).withColumns({"c0": F.lit(1.0), "x3": 2 * F.col("x1") + F.col("x2"), "w": (F.col("sid") % 7).cast("double")})
    return fit_formula(df, "y ~ x1 + c0 + x2 + x3 + w", stratum="sid").dropped(spark)


@query(f"WITH {CS} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {q(f'sum(x{i} * x{j})', 3)} AS v FROM cs" for i, j in ((1, 1), (1, 2), (2, 2))))
def q_gram(spark, sf_dir):
    return G.gram_table(choice_sets(spark, sf_dir), ["x1", "x2"]).withColumn("v", r("v", 3))


@query(f"WITH {CS} SELECT 'x1' AS name, CASE WHEN stddev_samp(x1) > 1 THEN {q('stddev_samp(x1)')} ELSE 1 END AS factor FROM cs UNION ALL SELECT 'x2', CASE WHEN stddev_samp(x2) > 1 THEN {q('stddev_samp(x2)')} ELSE 1 END FROM cs UNION ALL SELECT 'yy', CAST(1 AS DOUBLE)")
def q_scale_columns(spark, sf_dir):
    return P.scale_factors(choice_sets(spark, sf_dir).withColumn("yy", F.col("y").cast("double")), ["x1", "x2", "yy"]).withColumn("factor", r("factor"))


@query(f"WITH {CS} SELECT {KEY_SQL}, CASE WHEN l_linenumber - 1 >= 3 THEN '3+' ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS bin FROM cs")
def q_bin_counts(spark, sf_dir):
    return choice_sets(spark, sf_dir).select(*KEYS, L.bin_counts(F.col("l_linenumber") - 1).alias("bin"))


@query(f"WITH {CS} SELECT {KEY_SQL}, {q('corr', 9)} AS corr FROM cs")
def q_sampling_offset(spark, sf_dir):
    size = F.when(F.col("ls") == "F", F.lit(50.0)).otherwise(F.lit(500.0))
    return choice_sets(spark, sf_dir).select(*KEYS, r(P.sampling_offset(None, "sid", "ls", size), 9).alias("corr"))


# --- filters -------------------------------------------------------------------------------------------


@query(f"WITH {CS} SELECT {KEY_SQL}, y FROM cs JOIN orders ON sid = o_orderkey WHERE year(o_orderdate) BETWEEN 1993 AND 1995")
def q_year_filter(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), F.year("o_orderdate").alias("year"))
    return P.range_filter(choice_sets(spark, sf_dir).join(orders, "sid"), "year", 1993, 1995).select(*KEYS, "y")


@query(f"WITH {CS} SELECT {KEY_SQL}, y FROM cs WHERE sid IN (SELECT sid FROM cs WHERE y = 1 AND x2 BETWEEN 1 AND 3)")
def q_group_attr_filter(spark, sf_dir):
    return P.group_range_filter(choice_sets(spark, sf_dir), "sid", "y", "x2", 1, 3, KEYS[1:]).select(*KEYS, "y")


@query(f"WITH {CS} SELECT {KEY_SQL}, y FROM cs WHERE sid IN (SELECT sid FROM cs WHERE y = 1 AND ls = 'F') AND (y = 1 OR ls = 'F')")
def q_semi_restrict(spark, sf_dir):
    return P.restrict(choice_sets(spark, sf_dir), "sid", "y", F.col("ls") == "F").select(*KEYS, "y")


@query(f"WITH {CS} SELECT CAST(count(DISTINCT sid) AS BIGINT) AS n_sets FROM cs")
def q_distinct_sets(spark, sf_dir):
    return choice_sets(spark, sf_dir).agg(F.countDistinct("sid").alias("n_sets"))


# --- likelihood ----------------------------------------------------------------------------------------

SOFT = (
    f"{CS}, e AS (SELECT *, {BETA[0]} * x1 + {BETA[1]} * x2 AS eta FROM cs), m AS (SELECT *, max(eta) OVER (PARTITION BY sid) AS top FROM e), "
    "soft AS (SELECT *, exp(eta - top) / sum(exp(eta - top)) OVER (PARTITION BY sid) AS prob, top + ln(sum(exp(eta - top)) OVER (PARTITION BY sid)) AS log_sum FROM m), "
    "g AS (SELECT sid, sum(prob * x1) AS m1, sum(prob * x2) AS m2, sum(prob * x1 * x1) AS m11, sum(prob * x1 * x2) AS m12, sum(prob * x2 * x2) AS m22, sum(y * x1) AS c1, sum(y * x2) AS c2, sum(y * (eta - log_sum)) AS ll FROM soft GROUP BY sid)"
)


def _soft(spark, sf_dir):
    return G.softmax(choice_sets(spark, sf_dir), "sid", ["x1", "x2"], BETA)


@query(f"WITH {SOFT} SELECT {KEY_SQL}, {q('prob')} AS prob FROM soft")
def q_softmax(spark, sf_dir):
    return _soft(spark, sf_dir).select(*KEYS, r("prob").alias("prob"))


@query(f"WITH {SOFT} SELECT {q('sum(ll)', 4)} AS loglik FROM g")
def q_loglik_at(spark, sf_dir):
    return G.loglik_at(_soft(spark, sf_dir), "sid", "y", ["x1", "x2"]).withColumn("loglik", r("loglik", 4))


@query(f"WITH {SOFT} SELECT 'x1' AS term, {q('sum(c1 - m1)', 4)} AS g FROM g UNION ALL SELECT 'x2', {q('sum(c2 - m2)', 4)} FROM g")
def q_gradient_at(spark, sf_dir):
    return G.gradient_at(_soft(spark, sf_dir), "sid", "y", ["x1", "x2"]).withColumn("g", r("g", 4))


@query(f"WITH {SOFT} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {q(f'sum(m{i} * m{j} - m{i}{j})', 4)} AS h FROM g" for i, j in ((1, 1), (1, 2), (2, 2))))
def q_hessian_at(spark, sf_dir):
    return G.hessian_at(_soft(spark, sf_dir), "sid", "y", ["x1", "x2"]).withColumn("h", r("h", 4))


# --- fits ----------------------------------------------------------------------------------------------

TERMS = ["x1", "x2", "fN", "fR"]
DESIGN4 = f"SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, x2 AS v2, CAST({is_('N')} AS DOUBLE) AS v3, CAST({is_('R')} AS DOUBLE) AS v4 FROM cs"
DESIGN2 = "SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, x2 AS v2 FROM cs"
FIT4 = f"WITH {CS}, {chain('t', DESIGN4, 4)}"
FITO = f"WITH {CS}, {chain('t', DESIGN4.replace('CAST(0 AS DOUBLE) AS off', 'corr AS off'), 4)}"
FIT2 = f"WITH {CS}, {chain('t', DESIGN2, 2)}"


def _rows(names: list[str], per: Callable[[int], list[str]], columns: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS term, {', '.join(f'{e} AS {c}' for e, c in zip(per(i), columns))} FROM {source}" for i, n in enumerate(names, 1))


def fit4(spark, sf_dir, **options) -> ClogitFit:
    return fit_formula(choice_sets(spark, sf_dir), "y ~ x1 + x2 + f", stratum="sid", **options)


def _estimates(spark, fit: ClogitFit) -> DataFrame:
    return frame(spark, [(n, b, s, fit.loglik) for n, b, s in zip(fit.names, fit.beta.tolist(), fit.se(False).tolist())], "term string, estimate double, std_error double, loglik double").withColumns(
        {"estimate": r("estimate"), "std_error": r("std_error"), "loglik": r("loglik", 4)}
    )


def _estimates_sql(names: list[str]) -> str:
    return _rows(names, lambda i: [q(f"b{i}"), q(f"sqrt(v_{i}_{i})"), q("ll", 4)], ["estimate", "std_error", "loglik"], "tb, tv, tll")


@query(f"{FIT2} {_estimates_sql(['x1', 'x2'])}")
def q_fit_basic(spark, sf_dir):
    return _estimates(spark, fit_matrix(choice_sets(spark, sf_dir), ["x1", "x2"], choice="y", stratum="sid"))


@query(f"{FIT4} {_estimates_sql(TERMS)}")
def q_fit_factor(spark, sf_dir):
    return _estimates(spark, fit4(spark, sf_dir))


@query(f"{FITO} {_estimates_sql(TERMS)}")
def q_fit_offset(spark, sf_dir):
    return _estimates(spark, fit4(spark, sf_dir, offset="corr"))


@query(f"{FIT4} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {q(f'v_{i}_{j}', 9)} AS v FROM tv" for i in range(1, 5) for j in range(1, 5)))
def q_vcov(spark, sf_dir):
    v = fit4(spark, sf_dir).vcov()
    return frame(spark, [(i + 1, j + 1, float(v[i, j])) for i in range(4) for j in range(4)], "i int, j int, v double").withColumn("v", r("v", 9))


@query(f"{FIT4} SELECT {q('ll', 4)} AS loglik, CAST(4 AS BIGINT) AS df, (SELECT count(*) FROM cs) AS nobs FROM tll")
def q_loglik_row(spark, sf_dir):
    return frame(spark, [tuple(fit4(spark, sf_dir).loglik_row().values())], "loglik double, df long, nobs long").withColumn("loglik", r("loglik", 4))


@query(f"{FIT4} " + _rows(TERMS, lambda i: [q(f"b{i} - {Z95} * sqrt(v_{i}_{i})"), q(f"b{i} + {Z95} * sqrt(v_{i}_{i})")], ["conf_low", "conf_high"], "tb, tv"))
def q_confint(spark, sf_dir):
    rows = fit4(spark, sf_dir).confint()
    return frame(spark, [(x["term"], x["2.5 %"], x["97.5 %"]) for x in rows], "term string, conf_low double, conf_high double").withColumns({"conf_low": r("conf_low"), "conf_high": r("conf_high")})


def _tidy_sql(turn: str) -> str:
    t = (lambda e: f"exp({e})") if turn else (lambda e: e)
    return _rows(TERMS, lambda i: [q(t(f"b{i}")), q(f"sqrt(v_{i}_{i})"), q(f"b{i} / sqrt(v_{i}_{i})", 4), q(t(f"(b{i} - {Z95} * sqrt(v_{i}_{i}))")), q(t(f"(b{i} + {Z95} * sqrt(v_{i}_{i}))"))], ["estimate", "std_error", "statistic", "conf_low", "conf_high"], "tb, tv")


def _tidy(spark, fit, **options):
    t = fit.tidy(spark, **options).drop("p_value")
    return t.withColumns({c: r(c, 4 if c == "statistic" else 6) for c in t.columns[1:]})


@query(f"{FIT4} {_tidy_sql('')}")
def q_tidy(spark, sf_dir):
    return _tidy(spark, fit4(spark, sf_dir))


@query(f"{FIT4} {_tidy_sql('exp')}")
def q_odds_ratios(spark, sf_dir):
    return _tidy(spark, fit4(spark, sf_dir), exponentiate=True)


def _packed(spark, sf_dir):
    from ..operators.pack import pack, rows_of

    df = choice_sets(spark, sf_dir)
    own = D.build(df, parse("y ~ x1 + x2 + f"))
    return pack(rows_of(df, stratum="sid", y=F.col("y"), x=own.columns, offset=None, cluster="cid", order_by=[]), 4, read(spark, sf_dir, "lineitem").count())


CLUSTERED = f"{FIT4}, w AS (SELECT cid, {', '.join(f'sum(u{i}) AS u{i}' for i in range(1, 5))} FROM tu GROUP BY cid)"


@query(f"{CLUSTERED} SELECT cid, {', '.join(f'{q(f"u{i}", 4)} AS u{i}' for i in range(1, 5))} FROM w")
def q_cluster_scores(spark, sf_dir):
    from ..operators.kernel import cluster_scores

    scores = cluster_scores(_packed(spark, sf_dir), 4, fit4(spark, sf_dir).beta, None)
    return scores.select(F.col("cluster").alias("cid"), *(r(f"u{i}", 4).alias(f"u{i + 1}") for i in range(4)))


PAIRS = [(i, j) for i in range(1, 5) for j in range(1, 5) if i <= j]


@query(f"{CLUSTERED} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {q(f'sum(u{i} * u{j})', 2)} AS v FROM w" for i, j in PAIRS))
def q_meat(spark, sf_dir):
    from ..operators.kernel import cluster_scores, gram

    m = gram(cluster_scores(_packed(spark, sf_dir), 4, fit4(spark, sf_dir).beta, None), [f"u{i}" for i in range(4)])
    return frame(spark, [(i, j, float(m[i - 1, j - 1])) for i, j in PAIRS], "i int, j int, v double").withColumn("v", r("v", 2))


def _robust_sql(i: int) -> str:
    quadratic = " + ".join(f"v_{i}_{a} * k{min(a, b)}_{max(a, b)} * v_{b}_{i}" for a in range(1, 5) for b in range(1, 5))
    return q(f"sqrt(n / (n - 1) * (groups - 1) / groups * ({quadratic}))")


@query(
    f"{CLUSTERED}, k AS (SELECT CAST(count(*) AS DOUBLE) AS n, {', '.join(f'sum(u{i} * u{j}) AS k{i}_{j}' for i, j in PAIRS)} FROM w), n AS (SELECT CAST(count(*) AS DOUBLE) AS groups FROM tu) "
    + _rows(TERMS, lambda i: [_robust_sql(i)], ["robust_se"], "tv, k, n")
)
def q_robust_se(spark, sf_dir):
    fit = fit4(spark, sf_dir, cluster="cid", order_by=KEYS[1:])
    return frame(spark, list(zip(fit.names, fit.se(True).tolist())), "term string, robust_se double").withColumn("robust_se", r("robust_se"))


# --- mediation -----------------------------------------------------------------------------------------

KHB_ROWS = f"{CS}, z0 AS (SELECT *, x2 + 0.5 * x1 AS z FROM cs), dm AS (SELECT *, x1 - avg(x1) OVER (PARTITION BY sid) AS xd, z - avg(z) OVER (PARTITION BY sid) AS zd FROM z0), co AS (SELECT sum(xd * zd) / sum(xd * xd) AS c FROM dm), rs AS (SELECT dm.*, zd - c * xd AS resid FROM dm, co)"


def _khb_frame(spark, sf_dir):
    return choice_sets(spark, sf_dir).withColumn("z", F.col("x2") + 0.5 * F.col("x1"))


@query(f"WITH {KHB_ROWS} SELECT {KEY_SQL}, {q('xd')} AS x1_dm, {q('zd')} AS z_dm FROM dm")
def q_demean(spark, sf_dir):
    return K.demean(_khb_frame(spark, sf_dir), "sid", [("x1_dm", F.col("x1")), ("z_dm", F.col("z"))]).select(*KEYS, r("x1_dm").alias("x1_dm"), r("z_dm").alias("z_dm"))


def _residuals(spark, sf_dir):
    dm = K.demean(_khb_frame(spark, sf_dir), "sid", [("xd", F.col("x1")), ("zd", F.col("z"))])
    return dm, *K.residual_coefficients(dm, ["xd"], ["zd"])


@query(f"WITH {KHB_ROWS} SELECT {KEY_SQL}, {q('resid')} AS z_resid FROM rs")
def q_residualize(spark, sf_dir):
    dm, coef, _ = _residuals(spark, sf_dir)
    return dm.select(*KEYS, r(F.col("zd") - F.lit(float(coef[0, 0])) * F.col("xd")).alias("z_resid"))


@query(f"WITH {KHB_ROWS} SELECT 'z' AS term, {q('1 - sum(resid * resid) / sum(zd * zd)')} AS r2 FROM rs")
def q_resid_r2(spark, sf_dir):
    return frame(spark, [("z", _residuals(spark, sf_dir)[2]["zd"])], "term string, r2 double").withColumn("r2", r("r2"))


KHB_SQL = "WITH " + KHB_ROWS + ", " + chain("t", "SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, resid AS v2 FROM rs", 2) + ", " + chain("d", "SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, z AS v2 FROM rs", 2)


def _khb(spark, sf_dir):
    return K.khb(_khb_frame(spark, sf_dir), key_vars=["x1"], z_vars=["z"], stratum="sid", choice="y").tables(spark)


@query(
    f"{KHB_SQL}, k AS (SELECT tb.b1 AS t, sqrt(tv.v_1_1) AS ts, db.b1 AS d, sqrt(dv.v_1_1) AS ds FROM tb, tv, db, dv) SELECT 'x1' AS term, {q('t')} AS total, {q('ts')} AS total_se, {q('d')} AS direct, {q('ds')} AS direct_se, "
    f"{q('t - d')} AS indirect, {q('sqrt(ts * ts + ds * ds)')} AS indirect_se, {q('(t - d) / sqrt(ts * ts + ds * ds)', 4)} AS z, {q('t / d')} AS conf_ratio, {q('100 * (t - d) / t', 4)} AS conf_pct FROM k"
)
def q_khb(spark, sf_dir):
    t = _khb(spark, sf_dir)[0].drop("p_value")
    return t.withColumns({c: r(c, 4 if c in ("z", "conf_pct") else 6) for c in t.columns[1:]})


@query(f"{KHB_SQL} SELECT 'z' AS term, {q('db.b2')} AS estimate, {q('sqrt(dv.v_2_2)')} AS std_error, {q('db.b2 / sqrt(dv.v_2_2)', 4)} AS z FROM db, dv")
def q_khb_z_effects(spark, sf_dir):
    return _khb(spark, sf_dir)[1].drop("p_value").withColumns({"estimate": r("estimate"), "std_error": r("std_error"), "z": r("z", 4)})


# --- series and tables ---------------------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ONE = "SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1 FROM cs"


@query(f"WITH {CS}, {chain('m1', ONE, 1)}, {chain('m2', DESIGN2, 2)} SELECT 'm1' AS model, 'x1' AS term, {q('b1')} AS estimate FROM m1b UNION ALL SELECT 'm2', 'x1', {q('b1')} FROM m2b UNION ALL SELECT 'm2', 'x2', {q('b2')} FROM m2b")
def q_model_series(spark, sf_dir):
    t = run_series(choice_sets(spark, sf_dir), {"m1": "y ~ x1", "m2": "y ~ x1 + x2"}, stratum="sid")
    return t.select("model", "term", r("estimate").alias("estimate"))


def _segments(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cid"), F.col("c_mktsegment").alias("segment"))
    return choice_sets(spark, sf_dir).join(customers, "cid")


@query(
    f"WITH {CS}, sg AS (SELECT cs.*, c_mktsegment AS segment FROM cs JOIN customer ON cid = c_custkey), "
    + ", ".join(chain(f"s{k}", f"SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, x2 AS v2 FROM sg WHERE segment = '{s}'", 2) for k, s in enumerate(SEGMENTS))
    + " SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS subgroup, 'x{i}' AS term, {q(f'b{i}')} AS estimate FROM s{k}b" for k, s in enumerate(SEGMENTS) for i in (1, 2))
    + ") t WHERE subgroup IN (SELECT segment FROM sg GROUP BY segment HAVING count(*) >= 200)"
)
def q_subgroup_fit(spark, sf_dir):
    t = run_series(_segments(spark, sf_dir), {"m": "y ~ x1 + x2"}, subgroup_col="segment", stratum="sid")
    return t.filter("subgroup != 'all'").select("subgroup", "term", r("estimate").alias("estimate"))


@query(f"{FIT2} SELECT 'x1' AS term, {q('b1')} AS estimate, FALSE AS dropped, CAST(NULL AS VARCHAR) AS reason FROM tb UNION ALL SELECT 'x2', {q('b2')}, FALSE, NULL FROM tb UNION ALL SELECT 'x3', NULL, TRUE, 'collinear'")
def q_append_dropped(spark, sf_dir):
    fit = fit_formula(choice_sets(spark, sf_dir).withColumn("x3", F.col("x1") - F.col("x2")), "y ~ x1 + x2 + x3", stratum="sid")
    t = T.append_dropped(T.with_metadata(fit.tidy(spark), fit), fit.dropped(spark))
    return t.select("term", r("estimate").alias("estimate"), "dropped", "reason")


@query(f"{FIT4} " + _rows(TERMS, lambda i: [f"CASE WHEN abs(b{i} / sqrt(v_{i}_{i})) > 3.2905267314919255 THEN '***' WHEN abs(b{i} / sqrt(v_{i}_{i})) > 2.5758293035489004 THEN '**' WHEN abs(b{i} / sqrt(v_{i}_{i})) > 1.959963984540054 THEN '*' WHEN abs(b{i} / sqrt(v_{i}_{i})) > 1.6448536269514722 THEN '.' ELSE '' END"], ["stars"], "tb, tv"))
def q_format_stars(spark, sf_dir):
    return T.formatted(fit4(spark, sf_dir).tidy(spark)).select("term", "stars")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return fit4(spark, sf_dir).tidy(spark)


from . import more_queries  # noqa: E402, F401  (registers its queries with these)
