"""Newey-West regressions in SQL: systems solved by elimination, the covariance from lagged products as the textbook has it."""

from __future__ import annotations

from shockwell.plans.registry import Registry

#: erfc of |z| / sqrt(2) from a series of positive terms; beyond 8 nothing is left of it at the digits compared.
P_VALUE = """CASE WHEN abs({z}) / sqrt(2) >= 8 THEN 0.0 WHEN {z} = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 160), lambda i: exp(2 * i * ln(2) + (2 * i + 1) * ln(abs({z}) / sqrt(2)) + lgamma(i + 1) - lgamma(2 * i + 2) - {z} * {z} / 2))) END"""


def register_regression(r: Registry, name: str, source: str, by: str, x: list[str], lags: str, contrasts: dict[str, list[float]], years: bool | None = None) -> None:
    """CTEs ending in `name` (by, n, r_squared, term, estimate, std_error, p_value, ci_low, ci_high): y on x by group of `source`
    (by, pos, y, x and year), with `lags` (an expression of `by`). years: centred by year, False: by group, None: not."""
    k = len(x)
    keys = by.split(", ")
    own = lambda t: ", ".join(f"{t}.{c}" for c in keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    inside = f"OVER (PARTITION BY {by}{', year' if years else ''})"
    value = (lambda c: f"CAST({c} AS DOUBLE)") if years is None else (lambda c: f"CAST({c} AS DOUBLE) - avg({c}) {inside}")
    effects = "0" if years is None else "1" if not years else "count(DISTINCT year)"
    r.cte(f"{name}_rows", f"SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY pos) AS place, {value('y')} AS y, [{', '.join(value(c) for c in x)}] AS x FROM {source}")
    r.cte(f"{name}_sizes", f"SELECT {by}, count(*) AS n, var_pop(y) * count(*) AS total, {k} + {effects} AS fitted, any_value({lags}) AS lags FROM {source} GROUP BY {by}")
    r.cte(f"{name}_products", f"SELECT {by}, i, j, sum(x[i] * x[j]) AS v FROM {name}_rows CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS i) CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS j) GROUP BY ALL")
    r.cte(f"{name}_system", f"SELECT {by}, list(line ORDER BY i) AS m FROM (SELECT {by}, i, list_concat(list(v ORDER BY j), list(CASE WHEN i = j THEN 1.0 ELSE 0.0 END ORDER BY j)) AS line FROM {name}_products GROUP BY {by}, i) GROUP BY {by}")
    # a column that the ones before it make up has no pivot left: its line is emptied, so its coefficient is 0
    r.cte(f"{name}_steps", f"""SELECT {by}, 0 AS p, m, list_transform(m, lambda line, i: line[i]) AS d FROM {name}_system UNION ALL SELECT {by}, p + 1, CASE WHEN m[p + 1][p + 1] <= 1e-9 * d[p + 1]
      THEN list_transform(m, lambda line, i: CASE WHEN i = p + 1 THEN list_transform(line, lambda v: 0.0) ELSE line END)
      ELSE list_transform(m, lambda line, i: CASE WHEN i = p + 1 THEN list_transform(line, lambda v: v / line[p + 1])
      ELSE list_transform(line, lambda v, j: v - line[p + 1] * m[p + 1][j] / m[p + 1][p + 1]) END) END, d FROM {name}_steps WHERE p < {k}""")
    r.cte(f"{name}_inverse", f"SELECT {by}, list_transform(m, lambda line: line[{k + 1}:]) AS inv FROM {name}_steps WHERE p = {k}")
    r.cte(f"{name}_beta", f"SELECT {own('v')}, inv, list_transform(inv, lambda line: list_inner_product(line, xy)) AS beta FROM {name}_inverse v JOIN (SELECT {by}, list(s ORDER BY j) AS xy FROM (SELECT {by}, j, sum(x[j] * y) AS s FROM {name}_rows CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS j) GROUP BY ALL) GROUP BY {by}) q ON {on('v', 'q')}")
    r.cte(f"{name}_scores", f"SELECT {own('w')}, place, u, list_transform(x, lambda v: v * u) AS s FROM (SELECT {own('w')}, place, x, y - list_inner_product(x, beta) AS u FROM {name}_rows w JOIN {name}_beta b ON {on('w', 'b')}) w")
    r.cte(f"{name}_terms", f"SELECT unnest([{', '.join(repr(t) for t in contrasts)}]) AS term, unnest([{', '.join(str(list(map(float, w))) for w in contrasts.values())}]) AS w")
    # a contrast's variance is that of one series: its scores' projections, with Bartlett weights on their lagged products
    r.cte(f"{name}_series", f"SELECT {own('c')}, term, place, list_inner_product(s, list_transform(inv, lambda line: list_inner_product(line, w))) AS v FROM {name}_scores c JOIN {name}_beta b ON {on('c', 'b')} CROSS JOIN {name}_terms")
    r.cte(f"{name}_lagged", f"""SELECT {own('a')}, a.term, sum(CASE WHEN a.place = b.place THEN 1.0 ELSE 2 * (1 - (a.place - b.place) / (lags + 1.0)) END * a.v * b.v) AS v FROM {name}_series a JOIN {name}_sizes z ON {on('a', 'z')}
      JOIN {name}_series b ON {on('a', 'b')} AND a.term = b.term AND b.place BETWEEN a.place - lags AND a.place GROUP BY ALL""")
    r.cte(f"{name}_told", f"SELECT {own('z')}, n, 1 - sse / total AS r_squared, t.term, list_inner_product(t.w, beta) AS estimate, sqrt(l.v * n / greatest(n - fitted, 1)) AS std_error FROM {name}_sizes z JOIN {name}_beta b ON {on('z', 'b')} JOIN (SELECT {by}, sum(u * u) AS sse FROM {name}_scores GROUP BY {by}) e ON {on('z', 'e')} JOIN {name}_lagged l ON {on('z', 'l')} JOIN {name}_terms t ON t.term = l.term")
    r.cte(name, f"SELECT *, {P_VALUE.format(z='(estimate / std_error)')} AS p_value, estimate - 1.959963984540054 * std_error AS ci_low, estimate + 1.959963984540054 * std_error AS ci_high FROM {name}_told")
