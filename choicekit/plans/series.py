"""Series of models: nested specifications, groups, sub-groups and KHB comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..fit import fit_formula
from ..functions.tables import append_dropped, with_metadata
from ..operators.khb import khb
from ..sources.tables import resumable
from .formula import parse


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def model_table(df: DataFrame, formula: str, *, label: str, group: str = "all", subgroup: str = "all", **options) -> DataFrame:
    fit = fit_formula(df, formula, **options)
    spark = df.sparkSession
    table = append_dropped(with_metadata(fit.tidy(spark), fit, model=label, group=group, subgroup=subgroup), fit.dropped(spark))
    return table.fillna({"model": label, "group": group, "subgroup": subgroup})


def _levels(df: DataFrame, column: str | None, choice: str) -> list[str | None]:
    """Levels of a column among chosen rows."""
    if column is None:
        return [None]
    return [r[0] for r in df.filter((F.col(choice) == 1) & F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]


def run_series(df: DataFrame, specs: dict[str, str], *, group_col: str | None = None, subgroup_col: str | None = None, min_rows: int = 200, out: str | None = None, **options) -> DataFrame:
    """All specifications over all groups and, beside the whole group, its sub-groups of at least min_rows rows, as one table. With `out`, each model is written there and not fitted again."""
    spark = df.sparkSession
    formulas = [parse(f) for f in specs.values()]
    choice = formulas[0].response
    named = [options.get(o) for o in ("stratum", "cluster", "offset")]
    needed = [choice, group_col, subgroup_col, *named, *(c for f in formulas for c in f.columns), *(options.get("order_by") or [])]
    # every model reads these columns again and again, so what makes them runs once
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(c for c in needed if c in df.columns)]).persist(StorageLevel.MEMORY_AND_DISK)
    tables = []
    for group in _levels(df, group_col, choice):
        own = df if group is None else df.filter(F.col(group_col) == group)
        for sub in [None, *(_levels(own, subgroup_col, choice) if subgroup_col else [])]:
            part = own if sub is None else own.filter(F.col(subgroup_col) == sub)
            if sub is not None and part.count() < min_rows:
                continue
            for label, formula in specs.items():
                names = {"label": label, "group": str(group) if group is not None else "all", "subgroup": str(sub) if sub is not None else "all"}
                path = f"{out}/{names['group']}-{names['subgroup']}-{label}" if out else None
                tables.append(resumable(spark, path, lambda p=part, f=formula, n=names: model_table(p, f, **n, **options)))
    df.unpersist()
    return union_all(tables)


def khb_series(df: DataFrame, specs: dict[str, str], pairs: list[tuple[str, str]], *, key: str, stratum: str, out: str | None = None, **options) -> DataFrame:
    """Decompositions for pairs (reduced, full) of nested specifications: mediators are the terms that full adds, controls those of reduced but the key."""
    spark = df.sparkSession
    tables = []
    for low, high in pairs:
        a, b = parse(specs[low]), parse(specs[high])
        z = [t for t in b.labels if t not in a.labels and ":" not in t]
        controls = [t for t in a.labels if t != key]

        def make(z=z, controls=controls, choice=a.response, low=low, high=high):
            result = khb(df, key_vars=[key], z_vars=z, controls=controls, stratum=stratum, choice=choice, **options)
            return result.tables(spark)[0].withColumns({"comparison": F.lit(f"{low}-{high}"), "success": F.lit(result.success), "error": F.lit(result.error).cast("string")})

        tables.append(resumable(spark, f"{out}/khb-{low}-{high}" if out else None, make))
    return union_all(tables)
