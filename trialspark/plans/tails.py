"""Tail probabilities, quantiles and the signed-rank test as SQL for the checking engine.

Written another way than ``functions.special``: Simpson's rule over the densities, and bisection for quantiles.
"""

from __future__ import annotations

PANELS = 1000


def simpson(density: str, upper: str, panels: int = PANELS, lower: str = "0") -> str:
    """Integral from ``lower`` to ``upper`` of ``density``, an expression in ``v``."""
    value = density.replace("{v}", f"(({lower}) + (({upper}) - ({lower})) * i / {panels})")
    weight = f"CASE WHEN i = 0 OR i = {panels} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {panels + 1}), lambda i: {weight} * {value})) * (({upper}) - ({lower})) / {3 * panels})"


def norm_sf(z: str) -> str:
    """Upper normal tail for z >= 0."""
    return f"greatest(0, 0.5 - {simpson('exp(-{v} * {v} / 2) / sqrt(2 * pi())', f'least({z}, 12)')})"


def _horner(coefs: list[float], x: str) -> str:
    out = repr(coefs[0]) + "::DOUBLE"
    for k in coefs[1:]:
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


# Hart's rational approximation of the normal tail, highest power first.
_TAIL_TOP = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
_TAIL_BASE = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def norm_cdf(z: str) -> str:
    """Normal distribution function of any ``z``, right to about 1e-15."""
    far = "exp(-y * y / 2) / sqrt(2 * pi()) / (y + 1 / (y + 2 / (y + 3 / (y + 4 / (y + 0.65)))))"
    tail = f"CASE WHEN y < 7.07 THEN exp(-y * y / 2) * {_horner(_TAIL_TOP, 'y')} / {_horner(_TAIL_BASE, 'y')} ELSE {far} END"
    lower = f"list_transform([abs({z})::DOUBLE], lambda y: {tail})[1]"
    return f"CASE WHEN ({z}) > 0 THEN 1 - {lower} ELSE {lower} END"


def norm_ppf(p: str, steps: int = 30) -> str:
    """Normal quantile by Newton's method from the logistic one, steps of at most 1."""
    step = f"(({norm_cdf('z')}) - p) / (exp(-z * z / 2) / sqrt(2 * pi()))"
    start = f"ln(({p}) / (1 - ({p}))) / 1.702"
    return f"list_reduce(list_prepend(({start})::DOUBLE, list_transform(range(0, {steps}), lambda turn: ({p})::DOUBLE)), lambda z, p: z - greatest(-1, least(1, {step})))"


def f_ppf(alpha: str, d1: str, d2: str) -> str:
    """Point with upper F tail ``alpha``, below 512, to 2^-40: binary digits from the highest on."""
    digits = "list_transform(range(0, 50), lambda e: 2.0::DOUBLE ** (9 - e))"
    return f"list_reduce(list_prepend(0.0::DOUBLE, {digits}), lambda x, h: CASE WHEN {f_sf('(x + h)', d1, d2, 400)} > {alpha} THEN x + h ELSE x END)"


def ncf_sf(f: str, d1: str, d2: str, nc: str) -> str:
    """Upper tail of the noncentral F: Poisson weights times F tails with more degrees of freedom."""
    half = f"(({nc}) / 2)"
    weight = f"exp(-{half} + j * ln({half}) - lgamma(j + 1.0))"
    tail = f_sf(f"(({f}) * ({d1}) / (({d1}) + 2 * j))", f"(({d1}) + 2 * j)", d2, 400)
    return f"least(1, list_sum(list_transform(range(0, CAST({half} + 12 * sqrt({half}) + 40 AS INT)), lambda j: {weight} * ({tail}))))"


def srange_sf(source: str, keys: str) -> str:
    """CTEs from ``source`` (keys, q, k, df) to ``sr`` (keys, p): studentized range, Simpson's rule over z and over the spread s."""
    simp = lambda n: f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    at_z = "(i - 80) / 10.0::DOUBLE"
    return f"""zs AS (SELECT z, {simp(160)} * 0.1::DOUBLE / 3 * exp(-z * z / 2) / sqrt(2 * pi()) AS wz, {norm_cdf('z')} AS cz FROM (SELECT i, {at_z} AS z FROM range(0, 161) t(i))),
ss AS (SELECT *, {simp(64)} * exp((df - 1) * ln(s) - df * (s * s - 1) / 2) AS ws FROM (SELECT *, 1 + (i - 32) / 4.0::DOUBLE / sqrt(2.0 * df) AS s FROM {source}, range(0, 65) t(i)) WHERE s > 0),
rc AS (SELECT {keys}, s, ws, sum(wz * k * (cz - ({norm_cdf('(z - q * s)')})) ** (k - 1)) AS c FROM ss, zs GROUP BY {keys}, s, ws),
sr AS (SELECT {keys}, greatest(0, least(1, 1 - sum(ws * c) / sum(ws))) AS p FROM rc GROUP BY {keys})"""


def shapiro(source: str, keys: str, value: str, tie: str) -> str:
    """CTEs from ``source`` to ``sw``: keys, n, w and p of Royston's test, for more than 11 values a group."""
    # Published polynomial coefficients of algorithm AS R94, highest power first.
    last = _horner([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0], "u")
    second = _horner([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], "u")
    mean = _horner([0.0038915, -0.083751, -0.31082, -1.5861], "l")
    sd = _horner([0.0030302, -0.082676, -0.4803], "l")
    return f"""so AS (SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {value}, {tie}) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
sm AS (SELECT *, {norm_ppf('((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE))')} AS m FROM so),
sg AS (SELECT {keys}, n, sum(m * m) AS mm, sum(m * x) AS mx, var_pop(x) * n AS ss, max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2,
  max(x) FILTER (i = n) - max(x) FILTER (i = 1) AS outer_gap, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS inner_gap, 1 / sqrt(n) AS u, ln(n) AS l FROM sm GROUP BY {keys}, n),
sa AS (SELECT *, {last} + m1 / sqrt(mm) AS a1, {second} + m2 / sqrt(mm) AS a2 FROM sg),
sb AS (SELECT *, a1 * outer_gap + a2 * inner_gap + (mx - m1 * outer_gap - m2 * inner_gap)
  / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS top FROM sa),
sc AS (SELECT *, least(1, top * top / ss) AS w FROM sb),
sd AS (SELECT *, (ln(1 - w) - {mean}) / exp({sd}) AS z FROM sc),
sw AS (SELECT {keys}, n, w, {norm_cdf('-z')} AS p FROM sd)"""


def f_sf(f: str, d1: str, d2: str, panels: int = PANELS) -> str:
    """Upper tail of F: a beta integral with t = sin^2. Its density falls like exp(-d2 x^2 / 2) from its peak on (or from the
    upper end), so panels reach nine such widths down and stay fine for any degrees of freedom."""
    front = f"2 * exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0))"
    upper = f"atan(sqrt(({d2}) / (({d1}) * ({f}))))"
    lower = f"greatest(0, least({upper}, pi() / 2 - atan(sqrt((({d1}) - 1.0) / ({d2})))) - 9 / sqrt(({d2}) + 0.0))"
    inner = simpson(f"(sin({{v}}) ** (({d2}) - 1)) * (cos({{v}}) ** (({d1}) - 1))", upper, panels, lower=lower)
    return f"CASE WHEN ({f}) <= 0 THEN 1.0 ELSE least(1.0, {front} * {inner}) END"


def bisect(source: str, keys: str, above: str, high: float) -> str:
    """Recursive CTE ``bisect``: the point of [0, high] left of which ``above`` (in ``x``) holds, as ``lo``, per row of ``source``."""
    return f"""bisect AS (SELECT {keys}, 0.0::DOUBLE AS lo, {high}::DOUBLE AS hi, 0 AS step FROM {source}
UNION ALL SELECT {keys}, CASE WHEN up THEN x ELSE lo END, CASE WHEN up THEN hi ELSE x END, step + 1 FROM (SELECT *, {above} AS up FROM (SELECT *, (lo + hi) / 2 AS x FROM bisect WHERE step < 60))),
quantile AS (SELECT * FROM bisect WHERE step = 60)"""


# ways[n].w[s + 1]: subsets of 1..n with sum s
WAYS = """ways AS (SELECT 0 AS size, [1.0::DOUBLE] AS w UNION ALL
SELECT size + 1, list_transform(range(0, (size + 1) * (size + 2) // 2 + 1), lambda s: coalesce(w[s + 1], 0) + CASE WHEN s > size THEN coalesce(w[s - size], 0) ELSE 0 END) FROM ways WHERE size < 50)"""


def signed_rank(keys: str) -> str:
    """CTEs from ``d`` (keys and a difference ``d``) to ``tests``: keys, pairs, n, md, w, p_value."""
    on = " AND ".join(f"g.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    z = "abs(w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)"
    return f"""{WAYS},
r AS (SELECT *, rank() OVER o + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY {keys}, abs(d)) AS tied FROM d WHERE d <> 0 WINDOW o AS (PARTITION BY {keys} ORDER BY abs(d))),
g AS (SELECT {keys}, count(*) AS pairs, count(*) FILTER (d = 0) AS zeros, avg(d) AS md FROM d GROUP BY ALL),
s AS (SELECT {keys}, count(*) AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w, sum(tied * tied - 1) AS ties FROM r GROUP BY ALL),
tests AS (SELECT g.*, coalesce(n, 0) AS n, coalesce(s.w, 0) AS w, CASE WHEN n IS NULL THEN 1.0 WHEN n <= 50 AND zeros = 0 AND ties = 0
  THEN least(1, 2 * list_sum(ways.w[1:CAST(s.w AS INT) + 1]) / 2.0 ** n) ELSE least(1, 2 * {norm_sf(z.replace('(w', '(s.w'))}) END AS p_value
  FROM g LEFT JOIN s ON {on} LEFT JOIN ways ON ways.size = s.n)"""
