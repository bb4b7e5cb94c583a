"""Statements that fit a model in plain SQL: Newton steps as a chain of common table expressions."""

from __future__ import annotations


def chain(tag: str, source: str, p: int, steps: int = 7) -> str:
    """Expressions `<tag>b` (b1..bp), `<tag>v` (v_i_j, the inverse information), `<tag>ll` (ll) and `<tag>u` (sid, cid, u1..up) for rows (sid, cid, y, off, v1..vp) of source."""
    t, n = tag, range(1, p + 1)
    up = [(i, j) for i in n for j in n if i <= j]
    out = [f"{t}c AS MATERIALIZED ({source})", f"{t}b0 AS (SELECT {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in n)})"]

    def evaluation(k: str, b: str) -> list[str]:
        eta = " + ".join(f"v{i} * b{i}" for i in n)
        vs = ", ".join(f"v{i}" for i in n)
        means = ", ".join(f"sum(e * v{i}) / sum(e) AS m{i}" for i in n)
        products = ", ".join(f"sum(e * v{i} * v{j}) / sum(e) AS m{i}_{j}" for i, j in up)
        chosen = ", ".join(f"sum(y * v{i}) AS c{i}" for i in n)
        sums = ", ".join([*(f"sum(m{i}_{j} - m{i} * m{j}) AS h{i}_{j}" for i, j in up), *(f"sum(c{i} - m{i}) AS g{i}" for i in n), "sum(ll) AS ll"])
        h = lambda i, j: f"h{min(i, j)}_{max(i, j)}"
        first = ", ".join([*(f"{h(i, j)} AS a{i}_{j}" for i in n for j in n), *(f"g{i} AS a{i}_{p + 1}" for i in n), *(f"CAST({int(i == j)} AS DOUBLE) AS a{i}_{p + 1 + j}" for i in n for j in n)])
        rows = [
            f"{t}e{k} AS MATERIALIZED (SELECT sid, cid, y, {vs}, eta, exp(eta - max(eta) OVER (PARTITION BY sid)) AS e, max(eta) OVER (PARTITION BY sid) AS top FROM (SELECT {t}c.*, {eta} + off AS eta FROM {t}c, {b}) q)",
            f"{t}g{k} AS MATERIALIZED (SELECT sid, min(cid) AS cid, {means}, {products}, {chosen}, sum(y * eta) - max(top) - ln(sum(e)) AS ll FROM {t}e{k} GROUP BY sid)",
            f"{t}s{k} AS MATERIALIZED (SELECT {sums} FROM {t}g{k})",
            f"{t}r{k}_0 AS MATERIALIZED (SELECT {first} FROM {t}s{k})",
        ]
        for s in n:
            cells = ", ".join((f"a{s}_{j} / a{s}_{s}" if i == s else f"a{i}_{j} - a{i}_{s} * a{s}_{j} / a{s}_{s}") + f" AS a{i}_{j}" for i in n for j in range(1, 2 * p + 2))
            rows.append(f"{t}r{k}_{s} AS MATERIALIZED (SELECT {cells} FROM {t}r{k}_{s - 1})")
        return rows

    for k in range(steps):
        out += evaluation(str(k), f"{t}b{k}")
        out.append(f"{t}b{k + 1} AS MATERIALIZED (SELECT {', '.join(f'b{i} + a{i}_{p + 1} AS b{i}' for i in n)} FROM {t}b{k}, {t}r{k}_{p})")
    out += evaluation("z", f"{t}b{steps}")
    out.append(f"{t}b AS (SELECT * FROM {t}b{steps})")
    out.append(f"{t}v AS (SELECT {', '.join(f'a{i}_{p + 1 + j} AS v_{i}_{j}' for i in n for j in n)} FROM {t}rz_{p})")
    out.append(f"{t}ll AS (SELECT ll FROM {t}sz)")
    out.append(f"{t}u AS (SELECT sid, cid, {', '.join(f'c{i} - m{i} AS u{i}' for i in n)} FROM {t}gz)")
    return ",\n".join(out)


def long(names: list[str], cells: list[tuple[list[str], str]], source: str) -> str:
    """One SELECT per row of cells (expressions in the order of names), all over source."""
    return "\nUNION ALL ".join(f"SELECT {', '.join(f'{e} AS {n}' for n, e in zip(names, row))} FROM {source}" for row, _ in cells)
