"""SQL twins of iterative operators: Newton's method of the grouped fits, and drawn combinations."""

from __future__ import annotations

from tideledger.operators.search import SCRAMBLE
from tideledger.plans.base_sql import draw


def _solved(size: int) -> str:
    """Gauss-Jordan on the augmented matrix `m`, one pivot per element of the reduced list."""
    pivots = ", ".join(f"[[{k}e0]]" for k in range(size))
    k = "(b[1][1] + 1)::INT"
    return f"""list_reduce([m, {pivots}], lambda a, b: list_transform(range(0, {size}), lambda i:
        list_transform(range(0, {size + 1}), lambda j: CASE WHEN i = b[1][1] THEN a[{k}][j + 1] / a[{k}][{k}]
            ELSE a[i + 1][j + 1] - a[i + 1][{k}] * a[{k}][j + 1] / a[{k}][{k}] END)))"""


def newton(name: str, rows: str, size: int, steps: int = 20) -> dict[str, str]:
    """CTE `name`(k, w) of the coefficients that fit the rows (k, x, t, c, ridge, w0) of CTE `rows`.

    x begins with 1.0 for the intercept; c weighs a row, ridge penalises coefficients, w0 is the start.
    """
    n = range(1, size + 1)
    slopes = ", ".join(f"sum(c * (p - t) * x[{i}]) AS g{i}" for i in n)
    curves = ", ".join(f"sum(c * p * (1 - p) * x[{i}] * x[{j}]) AS h{i}_{j}" for i in n for j in n if i <= j)
    matrix = ", ".join("[" + ", ".join(
        f"h{min(i, j)}_{max(i, j)}" + (f" + ridge[{i}]" if i == j else "") for j in n)
        + f", -(g{i} + ridge[{i}] * w[{i}])]" for i in n)
    return {
        f"{name}_steps": f"""
          SELECT k, 0 AS it, any_value(w0)::DOUBLE[] AS w FROM {rows} GROUP BY k
          UNION ALL
          SELECT k, it + 1, list_transform(range(0, {size}), lambda i: w[i + 1] + s[i + 1][{size + 1}])
          FROM (SELECT k, it, w, {_solved(size)} AS s FROM (
            SELECT k, it, w, [{matrix}] AS m FROM (
              SELECT k, it, any_value(w) AS w, any_value(ridge)::DOUBLE[] AS ridge, {slopes}, {curves} FROM (
                SELECT r.*, f.it, f.w, 1 / (1 + exp(-list_dot_product(f.w, r.x))) AS p
                FROM {name}_steps f JOIN {rows} r USING (k) WHERE f.it < {steps})
              GROUP BY k, it)))""",
        name: f"SELECT k, w FROM {name}_steps WHERE it = {steps}",
    }


def sigmoids(name: str, rows: str, steps: int = 20) -> dict[str, str]:
    """CTE `name`(k, w): Platt's sigmoid of held-out rows (k, z, y) with smoothed targets."""
    return {
        f"{name}_rows": f"""SELECT k, [1e0, z] AS x, CASE WHEN y = 1 THEN (pos + 1.0) / (pos + 2.0)
              ELSE 1.0 / (neg + 2.0) END AS t, 1.0 AS c, [0.0, 0.0] AS ridge, [ln((pos + 1.0) / (neg + 1.0)), 0.0] AS w0
            FROM (SELECT *, sum(y) OVER (PARTITION BY k) AS pos, sum(1 - y) OVER (PARTITION BY k) AS neg FROM {rows})""",
        **newton(name, f"{name}_rows", 2, steps),
    }


def scrambled_sql(rules: str, count: str, bits: int, points: int = 200) -> dict[str, str]:
    """CTE drawn(rule_id, number): the first numbers of each rule's keyed permutation of 0 .. count - 1."""
    # one column a round, so that its value is not written out twice within the next
    inner = f"SELECT rule_id, i, turn, x, p0, p1, p2, p3 FROM walks WHERE NOT (turn > 0 AND x < {count})"
    for k, factor in enumerate(SCRAMBLE):
        inner = f"SELECT rule_id, i, turn, xor(y, y >> {(bits + 1) // 2}) AS x, p0, p1, p2, p3 FROM (SELECT *, (x * {factor} + p{k}) % {1 << bits} AS y FROM ({inner}))"
    drawn = ", ".join(f"{draw('42', 'rule_id', str(k))} AS p{k}" for k in range(len(SCRAMBLE)))
    return {
        "walks": f"""SELECT rule_id, i, 0 AS turn, i AS x, {drawn} FROM {rules}, range(0, {points}) t(i)
            UNION ALL SELECT rule_id, i, turn + 1, x, p0, p1, p2, p3 FROM ({inner})""",
        "drawn": f"SELECT rule_id, x AS number FROM walks WHERE turn > 0 AND x < {count}",
    }
