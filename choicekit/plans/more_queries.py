"""Queries for what the fixture of queries.py does not reach by itself: broken sets, mixed clusters, p-values, factor mediators, sinks, texts and errors."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..fit import fit_formula
from ..functions import tables as T
from ..operators import design as D
from ..operators import khb as K
from ..operators import prep as P
from ..sources import tables as S
from ..sources.simulate import simulate as make_choices
from .formula import parse
from .oracle import chain
from .queries import CS, FIT2, FIT4, KEY_SQL, KEYS, PAIRS, SEGMENTS, TERMS, Z95, BROKEN, _estimates, _estimates_sql, _robust_sql, _rows, _segments, choice_sets, fit4, frame, is_, q, query, r, read
from .series import khb_series, run_series

TWO = "y ~ x1 + x2"


def _quiet(f):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f()


def _fit2(df, **options):
    return _quiet(lambda: fit_formula(df, TWO, stratum="sid", **options))


# --- sets without or with several chosen rows, mixed clusters ------------------------------------------

ORDER = ", ".join(KEYS[1:])
FIRST = f"br AS (SELECT *, {BROKEN} AS yb FROM cs), fi AS (SELECT *, CASE WHEN yb = 1 AND row_number() OVER (PARTITION BY sid ORDER BY yb DESC, {ORDER}) = 1 THEN 1 ELSE 0 END AS y1, max(yb) OVER (PARTITION BY sid) AS any_y FROM br)"
BROKEN2 = f"WITH {CS}, {FIRST}, {chain('t', 'SELECT sid, cid, y1 AS y, CAST(0 AS DOUBLE) AS off, x1 AS v1, x2 AS v2 FROM fi WHERE any_y = 1', 2)}"


@query(f"{BROKEN2} {_estimates_sql(['x1', 'x2'])}")
def q_fit_broken_sets(spark, sf_dir):
    return _estimates(spark, _fit2(choice_sets(spark, sf_dir).withColumn("y", F.expr(BROKEN)), order_by=KEYS[1:]))


@query(f"WITH {CS}, {FIRST} SELECT CAST(count(*) AS BIGINT) AS n_obs, CAST(count(DISTINCT sid) AS BIGINT) AS n_sets, CAST(sum(yb) AS BIGINT) AS n_events FROM fi")
def q_broken_counts(spark, sf_dir):
    fit = _fit2(choice_sets(spark, sf_dir).withColumn("y", F.expr(BROKEN)), order_by=KEYS[1:])
    return frame(spark, [(fit.n_obs, fit.n_groups, fit.n_events)], "n_obs long, n_sets long, n_events long")


MIXED = f"mx AS (SELECT *, first_value(l_suppkey % 50) OVER (PARTITION BY sid ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cl FROM cs)"
MIXED4 = f"WITH {CS}, {MIXED}, {chain('t', f'SELECT sid, cl AS cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, x2 AS v2, CAST({is_("N")} AS DOUBLE) AS v3, CAST({is_("R")} AS DOUBLE) AS v4 FROM mx', 4)}"


@query(
    f"{MIXED4}, w AS (SELECT cid, {', '.join(f'sum(u{i}) AS u{i}' for i in range(1, 5))} FROM tu GROUP BY cid), k AS (SELECT CAST(count(*) AS DOUBLE) AS n, {', '.join(f'sum(u{i} * u{j}) AS k{i}_{j}' for i, j in PAIRS)} FROM w), n AS (SELECT CAST(count(*) AS DOUBLE) AS groups FROM tu) "
    + _rows(TERMS, lambda i: [_robust_sql(i)], ["robust_se"], "tv, k, n")
)
def q_robust_mixed_clusters(spark, sf_dir):
    df = choice_sets(spark, sf_dir).withColumn("cl", F.col("l_suppkey") % 50)
    fit = fit_formula(df, "y ~ x1 + x2 + f", stratum="sid", cluster="cl", order_by=KEYS[1:])
    return frame(spark, list(zip(fit.names, fit.se(True).tolist())), "term string, robust_se double").withColumn("robust_se", r("robust_se"))


# --- optimiser -----------------------------------------------------------------------------------------


@query(f"{FIT2} SELECT 'x1' AS term, {q('b1 - 8')} AS estimate, {q('sqrt(v_1_1)')} AS std_error, {q('ll', 4)} AS loglik FROM tb, tv, tll UNION ALL SELECT 'x2', {q('b2')}, {q('sqrt(v_2_2)')}, {q('ll', 4)} FROM tb, tv, tll")
def q_fit_far_start(spark, sf_dir):
    """An offset of 8 x1 puts the start so far away that full Newton steps overshoot and are halved."""
    return _estimates(spark, _fit2(choice_sets(spark, sf_dir).withColumn("o", 8 * F.col("x1")), offset="o"))


@query("SELECT FALSE AS converged, CAST(2 AS BIGINT) AS iterations")
def q_fit_stopped(spark, sf_dir):
    fit = _fit2(choice_sets(spark, sf_dir), max_iter=2)
    return frame(spark, [(fit.converged, fit.iterations)], "converged boolean, iterations long")


@query(f"{FIT4} {_estimates_sql(TERMS)}")
def q_fit_scaled(spark, sf_dir):
    """Columns are divided by their deviations for the fit, and its results are scaled back."""
    return _estimates(spark, fit4(spark, sf_dir, scale=True))


# --- tables --------------------------------------------------------------------------------------------

NOISE = "CAST(l_partkey * 31 % 101 AS DOUBLE) / 101"
NOISY = f"WITH {CS}, {chain('t', f'SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, {NOISE} AS v2, CAST(l_suppkey % 7 AS DOUBLE) / 7 AS v3 FROM cs', 3)}"


def _p_sql(z: str) -> str:
    """2 (1 - Phi(|z|)) by the series of the error function; good for |z| < 4."""
    return f"1 - 2 / sqrt(pi()) * (SELECT sum((CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(abs({z}) / sqrt(2)) - lgamma(n + 1)) / (2 * n + 1)) FROM range(40) t(n))"


@query(f"{NOISY} " + _rows(["noise", "supplier"], lambda i: [q(_p_sql(f"(b{i + 1} / sqrt(v_{i + 1}_{i + 1}))"))], ["p_value"], "tb, tv"))
def q_p_values(spark, sf_dir):
    df = choice_sets(spark, sf_dir).withColumns({"noise": F.expr(NOISE), "supplier": (F.col("l_suppkey") % 7).cast("double") / 7})
    t = fit_formula(df, "y ~ x1 + noise + supplier", stratum="sid").tidy(spark)
    return t.filter("term != 'x1'").select("term", r("p_value").alias("p_value"))


@query(
    f"{FIT2}, n AS (SELECT count(*) AS n_obs, CAST(sum(y) AS BIGINT) AS n_events, count(DISTINCT sid) AS n_sets FROM cs) "
    + _rows(["x1", "x2"], lambda i: ["'m'", q(f"exp(b{i})"), q(f"exp(b{i} - {Z95} * sqrt(v_{i}_{i}))"), q(f"exp(b{i} + {Z95} * sqrt(v_{i}_{i}))"), "n_obs", "n_events", "n_sets", q("ll", 4), "TRUE"], ["model", "odds_ratio", "or_low", "or_high", "n_obs", "n_events", "n_sets", "loglik", "converged"], "tb, tv, tll, n")
)
def q_metadata(spark, sf_dir):
    fit = _fit2(choice_sets(spark, sf_dir))
    t = T.with_metadata(fit.tidy(spark), fit, model="m").select("term", "model", "odds_ratio", "or_low", "or_high", *(F.col(c).cast("long").alias(c) for c in ("n_obs", "n_events", "n_sets")), "loglik", "converged")
    return t.withColumns({**{c: r(c) for c in ("odds_ratio", "or_low", "or_high")}, "loglik": r("loglik", 4)})


@query(f"{FIT4} " + _rows(TERMS, lambda i: [f"printf('%.3f', b{i}) || '***'", f"'[' || printf('%.3f', b{i} - {Z95} * sqrt(v_{i}_{i})) || ', ' || printf('%.3f', b{i} + {Z95} * sqrt(v_{i}_{i})) || ']'"], ["estimate_text", "ci_text"], "tb, tv"))
def q_formatted_texts(spark, sf_dir):
    return T.formatted(fit4(spark, sf_dir).tidy(spark)).select("term", "estimate_text", "ci_text")


@query(f"{FIT2}, n AS (SELECT count(*) AS n_obs, count(DISTINCT sid) AS n_sets FROM cs) SELECT 0 AS line, 'Conditional logit: ' || n_obs || ' rows, ' || n_sets || ' choice sets' AS text FROM n" + "".join(f" UNION ALL SELECT {i}, printf('%-24s%12.6f%12.6f%10.3f', 'x{i}', b{i}, sqrt(v_{i}_{i}), b{i} / sqrt(v_{i}_{i})) || printf('%12.6f%12.6f', b{i} - {Z95} * sqrt(v_{i}_{i}), b{i} + {Z95} * sqrt(v_{i}_{i})) FROM tb, tv" for i in (1, 2)))
def q_summary(spark, sf_dir):
    lines = _fit2(choice_sets(spark, sf_dir)).summary().split("\n")
    rows = [(0, lines[0]), *((i, x[:58] + x[69:]) for i, x in enumerate(lines[4:], 1))]  # without the column of p
    return frame(spark, rows, "line int, text string")


@query(f"{FIT2} SELECT 'ClogitFit(' || (SELECT count(*) FROM cs) || ' rows, ' || (SELECT count(DISTINCT sid) FROM cs) || ' sets, loglik ' || printf('%.4f', ll) || ', converged True: x1=' || printf('%.6f', b1) || ', x2=' || printf('%.6f', b2) || ')' AS text FROM tb, tll")
def q_print(spark, sf_dir):
    return frame(spark, [(repr(_fit2(choice_sets(spark, sf_dir))),)], "text string")


@query("SELECT * FROM (VALUES (0, 'p_value'), (1, 'term'), (2, 'estimate'), (3, 'std_error'), (4, 'statistic'), (5, 'conf_low'), (6, 'conf_high')) t(position, name)")
def q_column_order(spark, sf_dir):
    table = T.column_order(_fit2(choice_sets(spark, sf_dir)).tidy(spark), ["p_value", "absent", "term"])
    return frame(spark, list(enumerate(table.columns)), "position int, name string")


# --- design and errors ---------------------------------------------------------------------------------


@query(f"WITH {CS} SELECT {KEY_SQL}, {q('x1')} AS x1 FROM cs")
def q_design_skips_three_way(spark, sf_dir):
    df = choice_sets(spark, sf_dir)
    own = _quiet(lambda: D.build(df, parse("y ~ x1 + x1:x2:f")))
    return df.select(*KEYS, *(r(c).alias(n) for n, c in zip(own.names, own.columns)))


CASES = ["choice is not 0 or 1", "column is missing", "design is empty", "key is missing", "mediator is an interaction", "set without a choice", "two clusters, no order"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', TRUE)" for c in CASES) + ") t(what, refused)")
def q_argument_errors(spark, sf_dir):
    df = choice_sets(spark, sf_dir)
    khb = lambda d, **o: K.khb(d, **{"key_vars": ["x1"], "z_vars": ["x2"], "stratum": "sid", "choice": "y"} | o)
    tries = [
        lambda: fit_formula(df.withColumn("y", F.col("y") * 2), TWO, stratum="sid"), lambda: fit_formula(df, "y ~ x1 + nowhere", stratum="sid"), lambda: D.build(df, parse("y ~ x1:x2:f")),
        lambda: khb(df, key_vars=["nowhere"]), lambda: khb(df, z_vars=["x1:x2"]), lambda: khb(df.withColumn("y", F.expr(BROKEN))), lambda: fit_formula(df, TWO, stratum="sid", cluster="l_linenumber"),
    ]
    rows = []
    for what, f in zip(CASES, tries):
        try:
            _quiet(f)
            rows.append((what, False))
        except ValueError:
            rows.append((what, True))
    return frame(spark, rows, "what string, refused boolean")


# --- mediation -----------------------------------------------------------------------------------------

FACTOR_ROWS = (
    f"{CS}, n0 AS (SELECT *, CAST({is_('N')} AS DOUBLE) AS fn, CAST({is_('R')} AS DOUBLE) AS fr FROM cs), dm AS (SELECT *, x1 - avg(x1) OVER (PARTITION BY sid) AS xd, fn - avg(fn) OVER (PARTITION BY sid) AS nd, fr - avg(fr) OVER (PARTITION BY sid) AS rd FROM n0), "
    "co AS (SELECT sum(xd * nd) / sum(xd * xd) AS cn, sum(xd * rd) / sum(xd * xd) AS cr FROM dm), rs AS (SELECT dm.*, nd - cn * xd AS en, rd - cr * xd AS er FROM dm, co)"
)
KHB_COLUMNS = ["total", "total_se", "direct", "direct_se", "indirect"]


def _parts(table):
    return table.select("term", *(r(c).alias(c) for c in KHB_COLUMNS))


def _parts_sql(t: str, d: str) -> str:
    return f"SELECT 'x1' AS term, {q(f'{t}b.b1')} AS total, {q(f'sqrt({t}v.v_1_1)')} AS total_se, {q(f'{d}b.b1')} AS direct, {q(f'sqrt({d}v.v_1_1)')} AS direct_se, {q(f'{t}b.b1 - {d}b.b1')} AS indirect FROM {t}b, {t}v, {d}b, {d}v"


@query(f"WITH {FACTOR_ROWS}, {chain('t', 'SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, en AS v2, er AS v3 FROM rs', 3)}, {chain('d', 'SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, fn AS v2, fr AS v3 FROM rs', 3)} {_parts_sql('t', 'd')}")
def q_khb_factor_mediator(spark, sf_dir):
    return _parts(_quiet(lambda: K.khb(choice_sets(spark, sf_dir), key_vars=["x1"], z_vars=["f"], stratum="sid", choice="y")).tables(spark)[0])


STEP_ROWS = f"{CS}, dm AS (SELECT *, x1 - avg(x1) OVER (PARTITION BY sid) AS xd, x2 - avg(x2) OVER (PARTITION BY sid) AS zd FROM cs), co AS (SELECT sum(xd * zd) / sum(xd * xd) AS c FROM dm), rs AS (SELECT dm.*, zd - c * xd AS e FROM dm, co)"


@query(f"WITH {STEP_ROWS}, {chain('t', 'SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, e AS v2 FROM rs', 2)}, {chain('d', 'SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, x2 AS v2 FROM rs', 2)} SELECT *, '0-1' AS comparison, TRUE AS success FROM ({_parts_sql('t', 'd')}) p")
def q_khb_series(spark, sf_dir):
    t = khb_series(choice_sets(spark, sf_dir), {"0": "y ~ x1", "1": TWO}, [("0", "1")], key="x1", stratum="sid")
    return t.select("term", *(r(c).alias(c) for c in KHB_COLUMNS), "comparison", "success")


@query(
    f"WITH {CS}, {MIXED}, dm AS (SELECT *, x1 - avg(x1) OVER (PARTITION BY sid) AS xd, x2 - avg(x2) OVER (PARTITION BY sid) AS zd FROM mx), {chain('t', 'SELECT sid, cl AS cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, x2 AS v2 FROM dm', 2)}, "
    f"w AS (SELECT cid, sum(u1) AS u1, sum(u2) AS u2 FROM tu GROUP BY cid), k AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(u1 * u1) AS k1_1, sum(u1 * u2) AS k1_2, sum(u2 * u2) AS k2_2 FROM w), n AS (SELECT CAST(count(*) AS DOUBLE) AS groups FROM tu) "
    f"SELECT 'x1' AS term, {q('b1')} AS direct, {q('sqrt(n / (n - 1) * (groups - 1) / groups * (v_1_1 * k1_1 * v_1_1 + 2 * v_1_1 * k1_2 * v_2_1 + v_1_2 * k2_2 * v_2_1))')} AS direct_se FROM tb, tv, k, n"
)
def q_khb_clustered(spark, sf_dir):
    df = choice_sets(spark, sf_dir).withColumn("cl", F.col("l_suppkey") % 50)
    t = K.khb(df, key_vars=["x1"], z_vars=["x2"], stratum="sid", cluster="cl", choice="y", order_by=KEYS[1:]).tables(spark)[0]
    return t.select("term", r("direct").alias("direct"), r("direct_se").alias("direct_se"))


# --- series, sources and sinks -------------------------------------------------------------------------


@query(
    f"WITH {CS}, sg AS (SELECT cs.*, c_mktsegment AS segment FROM cs JOIN customer ON cid = c_custkey), "
    + ", ".join(chain(f"s{k}", f"SELECT sid, cid, y, CAST(0 AS DOUBLE) AS off, x1 AS v1, x2 AS v2 FROM sg WHERE segment = '{s}'", 2) for k, s in enumerate(SEGMENTS[:2]))
    + " "
    + " UNION ALL ".join(f"SELECT '{s}' AS part, 'x{i}' AS term, {q(f'b{i}')} AS estimate FROM s{k}b" for k, s in enumerate(SEGMENTS[:2]) for i in (1, 2))
)
def q_group_loop(spark, sf_dir):
    df = _segments(spark, sf_dir).filter(F.col("segment").isin(SEGMENTS[:2]))
    t = run_series(df, {"m": TWO}, group_col="segment", stratum="sid")
    return t.select(F.col("group").alias("part"), "term", r("estimate").alias("estimate"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def q_equal_filter(spark, sf_dir):
    df = S.read_columns(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderstatus", "nowhere"])
    return P.equal_filter(df, "o_orderstatus", "F")


@query(f"{FIT2} " + _rows(["x1", "x2"], lambda i: [q(f"b{i}")], ["estimate"], "tb"))
def q_written_table(spark, sf_dir):
    path = S.scratch(spark)
    S.write_table(_fit2(choice_sets(spark, sf_dir)).tidy(spark), path, "csv")
    t = spark.read.option("header", True).schema("term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double").csv(path)
    return t.select("term", r("estimate").alias("estimate"))


@query(f"{FIT2} {_estimates_sql(['x1', 'x2'])}")
def q_saved_fit(spark, sf_dir):
    path = S.scratch(spark)
    S.save_fit(spark, _fit2(choice_sets(spark, sf_dir)), path)
    return _estimates(spark, S.load_fit(spark, path))


@query("SELECT CAST(1 AS BIGINT) AS made, CAST(25 AS BIGINT) AS n_rows")
def q_resumed_table(spark, sf_dir):
    path, made = S.scratch(spark), []

    def make():
        made.append(1)
        return read(spark, sf_dir, "nation")

    for _ in range(2):
        t = S.resumable(spark, path, make)
    return t.agg(F.lit(len(made)).cast("long").alias("made"), F.count(F.lit(1)).alias("n_rows"))


# --- generated choices ---------------------------------------------------------------------------------


def _simulate_sql(egos: int, alts: int) -> str:
    from ..sources.simulate import _POISSON, CONTINUOUS, FACTOR, SHARES, SIZES

    def u(seed: int, *key: str) -> str:
        return f"(CAST(CAST('0x' || substr(md5('{seed}' || {' || '.join(f"':' || {k}" for k in key)}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / {1 << 52}::DOUBLE"

    own, at, columns = ("s", "a"), 42_000, []
    for name in CONTINUOUS:
        at += 2
        if "lnDist" in name:
            columns.append(f"9 + 2 * (sqrt(-2 * ln({u(at, *own)})) * cos(2 * pi() * {u(at + 1, *own)})) AS {name}")
        else:
            columns.append(f"CAST({' + '.join(f'CAST({u(at, *own)} > {p!r}::DOUBLE AS INTEGER)' for p in _POISSON)} AS DOUBLE) AS {name}")
    for name, levels in FACTOR.items():
        at += 2
        columns.append(f"CAST(floor({u(at, *own)} * {len(levels) + 1}) + 1 AS INTEGER) AS {name}_raw")
    edges = [sum(SHARES[:k]) for k in range(1, len(SHARES))]
    columns.append(f"{u(at + 2, *own)} AS su")
    columns.append(f"{u(at + 4, *own)} AS gu")
    columns.append(f"CAST(floor({u(at + 6, 's')} * {max(1, round(egos / 1.3))}) + 1 AS INTEGER) AS cluster_id")
    stratum = "CASE " + " ".join(f"WHEN su < {e!r}::DOUBLE THEN {k}" for k, e in enumerate(edges, 1)) + f" ELSE {len(SHARES)} END"
    size = "CASE st " + " ".join(f"WHEN {k} THEN {x!r}::DOUBLE" for k, x in enumerate(SIZES, 1)) + " END"
    dummies = {f"{f}_{v}": f"CASE WHEN {f}_raw = {k} THEN 1::DOUBLE ELSE 0::DOUBLE END" for f, levels in FACTOR.items() for k, v in enumerate(levels, 2)}
    truth = {**CONTINUOUS, **{f"{f}_{v}": b for f, levels in FACTOR.items() for v, b in levels.items()}}
    eta = " + ".join(["correction", *(f"{b!r}::DOUBLE * {n}" for n, b in truth.items())])
    shown = ", ".join([*(f"{q(n)} AS {n}" for n in [*CONTINUOUS, *dummies, "correction"]), *(f"{f}_raw" for f in FACTOR)])
    return (
        f"WITH g AS (SELECT CAST(i // {alts} + 1 AS INTEGER) AS s, CAST(i % {alts} + 1 AS INTEGER) AS a FROM range({egos * alts}) t(i)), d AS (SELECT s AS strata_id, a, {', '.join(columns)} FROM g), "
        f"e AS (SELECT *, {stratum} AS st, {', '.join(f'{v} AS {n}' for n, v in dummies.items())} FROM d), o AS (SELECT *, -ln(count(*) OVER (PARTITION BY strata_id, st) / {size}) AS correction FROM e) "
        f"SELECT CASE WHEN row_number() OVER (PARTITION BY strata_id ORDER BY {eta} - ln(-ln(gu)) DESC, a) = 1 THEN 1 ELSE 0 END AS choice, strata_id, cluster_id, {shown} FROM o"
    )


@query(_simulate_sql(5000, 100))
def q_simulate(spark, sf_dir):
    df = make_choices(spark)[0]
    return df.withColumns({c: r(c) for c, t in df.dtypes if t == "double"})


@query("SELECT * FROM (VALUES ('AgeDiffcat_2', -0.2::DOUBLE), ('AgeDiffcat_3', -0.5), ('AgeDiffcat_4', -0.8), ('AgeDiffcat_5', -1.2), ('Edudiff3_BothHigh', 0.8), ('Edudiff3_BothLow', 0.4), ('Edudiff3_Missing', -0.3), ('lnDist', -0.5), ('n_years_same_cfar', 1.0), ('n_years_same_peorg', 0.8), ('n_years_same_uni', 0.6)) t(term, estimate)")
def q_true_coefficients(spark, sf_dir):
    return frame(spark, list(make_choices(spark)[1].items()), "term string, estimate double")
