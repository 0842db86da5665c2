"""The expected result of each registered query, as SQL over the test tables.

Statements are put together from named steps: a step is a CTE, and a statement lists the steps
it needs. The SQL follows the definitions, not the Spark plans: cells are found by rounding
cube coordinates, pooling is a join, tail probabilities are integrated numerically.
"""

from __future__ import annotations

import math

from hexlytics import constants as K
from workload.fixture import DUCKDB, raw_sql


def _num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _near(text: str) -> str:
    return f"CAST(floor(CAST({text} AS DOUBLE) / 7 + 0.5) AS BIGINT)"


def _parent(child_res: int, i: str, j: str) -> tuple[str, str]:
    if child_res in (10, 8):
        return _near(f"(3*{i} - {j})"), _near(f"({i} + 2*{j})")
    return _near(f"(2*{i} + {j})"), _near(f"(3*{j} - {i})")


def _category(column: str) -> str:
    whens = " ".join(
        f"WHEN trim(upper({column})) IN ({', '.join(repr(t) for t in types)}) THEN '{name}'"
        for name, types in K.CATEGORY_TYPES.items()
    )
    return f"CASE {whens} ELSE '{K.UNCLASSIFIED}' END"


def _tolerant(column: str, kind: str) -> str:
    if kind == "string":
        return column
    if kind == "bigint":
        return (
            f"coalesce(TRY_CAST(CASE WHEN regexp_full_match({column}, '[0-9]+') THEN {column} END"
            f" AS BIGINT), CASE WHEN TRY_CAST({column} AS DOUBLE) = floor(TRY_CAST({column} AS"
            f" DOUBLE)) THEN CAST(TRY_CAST({column} AS DOUBLE) AS BIGINT) END)"
        )
    return f"TRY_CAST({column} AS {kind})"


STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def _step(name: str, *needs: str, sql: str) -> None:
    STEPS[name] = (needs, sql)


def sql(body: str, *needs: str) -> str:
    """A statement with the CTEs it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in STEPS[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    ctes = [f"{n} AS ({STEPS[n][1]})" for n in order]
    body = body.replace("/*RECURSIVE*/", "")
    if body.lstrip().upper().startswith("WITH "):
        ctes.append(body.lstrip()[5:])
        return f"WITH {recursive}" + ",\n".join(ctes)
    return f"WITH {recursive}" + ",\n".join(ctes) + "\n" + body


_step("raw", sql=raw_sql(DUCKDB))

_step("typed", "raw", sql="SELECT " + ", ".join(
    f"{_tolerant(raw, kind)} AS {name}" for raw, name, kind in K.RAW_COLUMNS
) + """, coalesce(try_strptime(date, '%Y-%m-%dT%H:%M:%S'),
        try_strptime(date, '%m/%d/%Y %I:%M:%S %p')) AS datetime FROM raw""")

_BRONZE_IN = "latitude BETWEEN 41.0 AND 42.5 AND longitude BETWEEN -88.5 AND -87.0"
_step("l1", "typed", sql=f"""SELECT *, CAST(year(datetime) AS INT) AS year,
  CAST(month(datetime) AS INT) AS month FROM typed
  WHERE datetime IS NOT NULL AND {_BRONZE_IN}""")

_step("modes", "l1", sql="""SELECT year, month, field,
    arg_min(value, (-n, value)) AS mode FROM (
  SELECT year, month, field, value, count(*) AS n FROM (
    SELECT year, month, unnest(['beat_id', 'district_id', 'ward_id', 'community_area_id']) AS field,
      unnest([beat_id, district_id, ward_id, community_area_id]) AS value FROM l1)
  WHERE value IS NOT NULL GROUP BY ALL) GROUP BY year, month, field""")

_step("month_modes", "modes", sql="""SELECT year, month,
    max(CASE WHEN field = 'beat_id' THEN mode END) AS mode_beat_id,
    max(CASE WHEN field = 'district_id' THEN mode END) AS mode_district_id,
    max(CASE WHEN field = 'ward_id' THEN mode END) AS mode_ward_id,
    max(CASE WHEN field = 'community_area_id' THEN mode END) AS mode_community_area_id
  FROM modes GROUP BY year, month""")


def _cyclic(prefix: str, value: str, period: int) -> str:
    turn = f"2 * pi() * {value} / {period}.0"
    return (
        f"sin({turn}) AS {prefix}_sin, cos({turn}) AS {prefix}_cos"
    )


_step("filled", "l1", "month_modes", sql=f"""SELECT l1.* REPLACE (
    coalesce(location_type, 'UNKNOWN') AS location_type,
    coalesce(block_address, 'UNKNOWN') AS block_address,
    coalesce(crime_description, 'UNKNOWN') AS crime_description,
    {', '.join(f'coalesce({c}, mode_{c}, 0) AS {c}' for c in K.ID_FILL_COLUMNS)})
  FROM l1 LEFT JOIN month_modes USING (year, month)""")

_step("plane", "filled", sql=f"""SELECT *,
    (longitude - {_num(K.CITY_CENTRE[1])}) * {_num(K.KM_PER_LON)} AS px,
    (latitude - {_num(K.CITY_CENTRE[0])}) * {_num(K.KM_PER_LAT)} AS py FROM filled""")


def _cube(source: str, x: str, y: str, size: float, i: str, j: str) -> str:
    """Nearest cell by rounding cube coordinates and repairing the worst one."""
    root3 = math.sqrt(3.0)
    return f"""SELECT * EXCLUDE (fi, fj, a, b, d, ea, eb, ed),
      CAST(CASE WHEN ea > eb AND ea > ed THEN b + d ELSE a END AS BIGINT) AS {i},
      CAST(CASE WHEN ea > eb AND ea > ed THEN b WHEN eb > ed THEN a - d ELSE b END AS BIGINT) AS {j}
    FROM (SELECT *, abs(fi - a) AS ea, abs(fj - b) AS eb, abs(fi - fj - d) AS ed
      FROM (SELECT *, floor(fi + 0.5) AS a, floor(fj + 0.5) AS b, floor(fi - fj + 0.5) AS d
        FROM (SELECT *, {x} / {_num(size * root3)} + {y} / {_num(3 * size)} AS fi,
                {y} / {_num(1.5 * size)} AS fj FROM {source})))"""


_step("c10", "plane", sql=_cube("plane", "px", "py", K.FINEST_RADIUS_KM, "i10", "j10"))
for _r in (9, 8, 7, 6):
    _pi, _pj = _parent(_r + 1, f"i{_r + 1}", f"j{_r + 1}")
    _step(f"c{_r}", f"c{_r + 1}", sql=f"SELECT *, {_pi} AS i{_r}, {_pj} AS j{_r} FROM c{_r + 1}")

_CYCLIC = ", ".join([
    _cyclic("hour", "hour(datetime)", 24),
    _cyclic("dow", "(isodow(datetime) - 1)", 7),
    _cyclic("month", "month", 12),
])
_IDS = ", ".join(f"concat_ws(':', {r}, i{r}, j{r}) AS h3_r{r}" for r in K.RESOLUTIONS)
_STREET = (
    "regexp_replace(regexp_replace(regexp_replace(upper(coalesce(block_address, '')),"
    " '^\\d{3,4}XX\\s+', ''), '^\\d+\\s+', ''), '^\\s+|\\s+$', '', 'g')"
)
_step("l2", "c6", sql=f"""SELECT *, crime_type AS primary_type,
    {_category('crime_type')} AS crime_category,
    CAST(hour(datetime) AS INT) AS hour, CAST(isodow(datetime) - 1 AS INT) AS day_of_week,
    isodow(datetime) >= 6 AS is_weekend, {_CYCLIC}, {_STREET} AS street_norm, {_IDS},
    CAST(datetime AS DATE) AS date,
    CASE WHEN arrest_made THEN 1 ELSE 0 END AS hit FROM c6""")

# Serving rows: unknown arrest counts as no.
_step("view", "l2", sql="""SELECT datetime, primary_type, crime_category, street_norm, block_address,
    coalesce(arrest_made, false) AS arrest_made, hit, community_area_id, district_id, ward_id,
    h3_r6, h3_r7, h3_r8, h3_r9, h3_r10, date, year, month FROM l2""")

_step("daily", "l2", sql=" UNION ALL ".join(
    f"""SELECT {r} AS res, i{r} AS i, j{r} AS j, h3_r{r} AS cell, date, CAST(count(*) AS BIGINT) AS n_crimes,
    CAST(sum(hit) AS BIGINT) AS n_arrests FROM l2 GROUP BY ALL""" for r in K.RESOLUTIONS))

_step("prior", "daily", sql="""SELECT res, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
    sum(n_arrests) / CAST(sum(n_crimes) AS DOUBLE) AS prior FROM daily GROUP BY ALL""")


def rates(source: str) -> str:
    """Raw, smoothed and Wilson columns over n_crimes, n_arrests, prior."""
    return f"""SELECT *, p AS raw_rate, n_crimes < 5 AS low_conf,
      (5.0 * prior + n_arrests) / (5.0 + n_crimes) AS smoothed_rate,
      greatest(0.0, least(1.0, (p + z2 / (2 * n) - half) / (1 + z2 / n))) AS ci_low,
      greatest(0.0, least(1.0, (p + z2 / (2 * n) + half) / (1 + z2 / n))) AS ci_high
    FROM (SELECT *, CAST(1.96 AS DOUBLE) * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) AS half
      FROM (SELECT *, CAST(n_crimes AS DOUBLE) AS n, n_arrests / CAST(n_crimes AS DOUBLE) AS p,
        CAST(1.96 AS DOUBLE) * CAST(1.96 AS DOUBLE) AS z2 FROM {source}))"""


_step("dated", "daily", "prior", sql="""SELECT d.*, p.year, p.month, p.prior FROM daily d
    JOIN prior p ON p.res = d.res AND p.year = year(d.date) AND p.month = month(d.date)""")
_step("rated", "dated", sql=rates("dated"))


def offsets(k: int) -> str:
    pairs = [
        (a, b) for a in range(-k, k + 1) for b in range(-k, k + 1)
        if max(abs(a), abs(b), abs(a - b)) <= k
    ]
    return "(VALUES " + ", ".join(f"({a}, {b})" for a, b in pairs) + ") AS o(di, dj)"


def pooled(k: int) -> str:
    return f"""SELECT r.*, CAST(q.pooled_n AS BIGINT) AS pooled_n, CAST(q.pooled_k AS BIGINT) AS pooled_k,
      q.pooled_k / CAST(q.pooled_n AS DOUBLE) AS pooled_rate,
      (5.0 * prior + q.pooled_k) / (5.0 + q.pooled_n) AS pooled_smoothed
    FROM rated r JOIN (
      SELECT d.res, d.i, d.j, d.date, sum(n.n_crimes) AS pooled_n, sum(n.n_arrests) AS pooled_k
      FROM daily d CROSS JOIN {offsets(k)}
      JOIN daily n ON n.res = d.res AND n.date = d.date AND n.i = d.i + o.di AND n.j = d.j + o.dj
      GROUP BY ALL) q ON q.res = r.res AND q.i = r.i AND q.j = r.j AND q.date = r.date"""


_step("gold", "rated", sql=pooled(1))

_step("monthly", "daily", "prior", sql="""SELECT m.*, p.prior FROM (
    SELECT res, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, i, j, cell,
      CAST(sum(n_crimes) AS BIGINT) AS n_crimes, CAST(sum(n_arrests) AS BIGINT) AS n_arrests
    FROM daily GROUP BY ALL) m JOIN prior p USING (res, year, month)""")

_step("profile", "l2", sql="""SELECT c.*, s.unique_streets, t.top_crime_type FROM (
      SELECT h3_r9 AS cell, date, count(id) AS n_crimes, CAST(sum(hit) AS BIGINT) AS n_arrests
      FROM l2 GROUP BY ALL) c
    JOIN (SELECT h3_r9 AS cell, date, count(DISTINCT street_norm) AS unique_streets
      FROM l2 GROUP BY ALL) s USING (cell, date)
    LEFT JOIN (SELECT cell, date, arg_min(crime_type, (-n, crime_type)) AS top_crime_type FROM (
      SELECT h3_r9 AS cell, date, crime_type, count(*) AS n FROM l2
      WHERE crime_type IS NOT NULL GROUP BY ALL) GROUP BY ALL) t USING (cell, date)""")


def rolling(partition: str) -> str:
    over = ", ".join(
        f"""CAST(sum(n_crimes) OVER (PARTITION BY {partition} ORDER BY date
          RANGE BETWEEN INTERVAL {w - 1} DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_n_{w}"""
        for w in K.ROLLING_DAYS
    )
    return f"""SELECT *, n_arrests / CAST(n_crimes AS DOUBLE) AS arrest_rate, {over}
      FROM (SELECT *, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month FROM profile)"""


def centre(source: str) -> str:
    """lat, lon of the centre of (res, i, j): centre children down to level 10."""
    text = f"SELECT *, i AS xi, j AS xj FROM {source}"
    for level in (6, 7, 8, 9):
        if level + 1 in (10, 8):
            di, dj = "2*xi + xj", "3*xj - xi"
        else:
            di, dj = "3*xi - xj", "xi + 2*xj"
        text = f"""SELECT * REPLACE (CASE WHEN res <= {level} THEN {di} ELSE xi END AS xi,
          CASE WHEN res <= {level} THEN {dj} ELSE xj END AS xj) FROM ({text})"""
    s = K.FINEST_RADIUS_KM
    return f"""SELECT * EXCLUDE (xi, xj),
      {_num(K.CITY_CENTRE[0])} + {_num(1.5 * s)} * xj / {_num(K.KM_PER_LAT)} AS lat,
      {_num(K.CITY_CENTRE[1])} + {_num(s * math.sqrt(3.0))} * (xi - xj / 2.0) / {_num(K.KM_PER_LON)} AS lon
      FROM ({text})"""


_step("cell_list", "daily", sql="SELECT DISTINCT res, i, j, cell FROM daily")
_step("centres", "cell_list", sql=centre("cell_list"))


def summary(res: int, weighted: bool = True) -> str:
    w = "greatest(n_crimes, 1)" if weighted else "1"
    return f"""SELECT s.*, c.lat, c.lon FROM (
      SELECT cell AS h3_id, CAST(sum(n_crimes) AS BIGINT) AS n_crimes, CAST(sum(n_arrests) AS BIGINT) AS n_arrests,
        round_even(avg(CASE WHEN low_conf THEN 1.0 ELSE 0.0 END), 3) AS low_conf_share,
        sum(smoothed_rate * {w}) / CAST(sum({w}) AS DOUBLE) AS smoothed_rate,
        sum(pooled_smoothed * {w}) / CAST(sum({w}) AS DOUBLE) AS pooled_smoothed
      FROM gold WHERE res = {res} GROUP BY cell) s
      JOIN centres c ON c.cell = s.h3_id"""


def top(source: str, cell: str, value: str, alias: str) -> str:
    return f"""SELECT {cell} AS h3_id, {value} AS {alias}, n AS {alias}_count FROM (
      SELECT {cell}, {value}, count(*) AS n,
        row_number() OVER (PARTITION BY {cell} ORDER BY count(*) DESC, {value}) AS rn
      FROM {source} WHERE {value} IS NOT NULL GROUP BY {cell}, {value}) WHERE rn = 1"""


def context(source: str, cell: str) -> str:
    fields = [
        ("primary_type", "common_crime"), ("street_norm", "signature_street"),
        ("block_address", "signature_block"), ("district_id", "district_id"),
        ("ward_id", "ward_id"), ("community_area_id", "community_area_id"),
    ]
    first, *rest = [f"({top(source, cell, c, a)}) {a}" for c, a in fields]
    joins = " ".join(f"FULL JOIN {r} USING (h3_id)" for r in rest)
    return f"""SELECT * REPLACE (coalesce(common_crime.common_crime, 'UNKNOWN') AS common_crime,
        coalesce(signature_street.signature_street, 'UNKNOWN') AS signature_street,
        coalesce(signature_block.signature_block, 'UNKNOWN') AS signature_block)
      FROM {first} {joins}"""


def share(cell: str, focus: str | None, digits: int | None = 3, source: str = "view") -> str:
    count = f"count(*) FILTER (WHERE {focus})" if focus else "count(*)"
    ratio = f"{count} / CAST(count(*) AS DOUBLE)"
    ratio = f"round_even({ratio}, {digits})" if digits is not None else ratio
    return f"""SELECT {cell} AS h3_id, count(*) AS incident_total, {count} AS focus_count,
      {ratio} AS focus_share FROM {source} GROUP BY {cell}"""


def hotspots(res: int, focus: str | None, scope: str | None = None) -> str:
    """The merged per-cell frame of a selection, optionally within a list of cells."""
    cell = f"h3_r{res}"
    where = f"WHERE s.h3_id IN ({scope})" if scope else ""
    if focus is None:
        return f"""SELECT s.*, k.* EXCLUDE (h3_id), f.* EXCLUDE (h3_id),
          s.n_crimes AS selection_n_crimes FROM ({summary(res)}) s
          LEFT JOIN ({context('view', cell)}) k ON k.h3_id = s.h3_id
          LEFT JOIN ({share(cell, None)}) f ON f.h3_id = s.h3_id {where}"""
    chosen = f"(SELECT * FROM view WHERE {focus})"
    return f"""SELECT s.*, k.* EXCLUDE (h3_id), f.* EXCLUDE (h3_id, focus_share),
      coalesce(f.focus_share, 0.0) AS focus_share,
      coalesce(f.focus_count, 0) AS selection_n_crimes FROM ({summary(res)}) s
      LEFT JOIN ({context(chosen, cell)}) k ON k.h3_id = s.h3_id
      LEFT JOIN ({share(cell, focus)}) f ON f.h3_id = s.h3_id {where}"""


# ------------------------------------------------------------------- numeric tail probabilities

def integral(density: str, low: str, high: str, steps: int = 20000) -> str:
    """Simpson's rule; ``density`` is written over ``xx``."""
    return f"""(SELECT sum(CASE WHEN g = 0 OR g = {steps} THEN 1.0 WHEN g % 2 = 1 THEN 4.0 ELSE 2.0 END
        * ({density})) * (({high}) - ({low})) / {3 * steps}.0
      FROM (SELECT g, ({low}) + (({high}) - ({low})) * g / {steps}.0 AS xx FROM range({steps + 1}) r(g)))"""


def two_sided_normal(z: str) -> str:
    body = integral("exp(-xx * xx / 2) / sqrt(2 * pi())", "0", f"least(abs({z}), 12)")
    return f"greatest(0.0, 1.0 - 2.0 * {body})"


def two_sided_student(t: str, df: str) -> str:
    # With u = atan(x / sqrt(df)) the density becomes a power of a cosine on a bounded range.
    ratio = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    body = integral(f"pow(cos(xx), {df} - 1)", "0", f"atan(abs({t}) / sqrt({df}))")
    return f"greatest(0.0, 1.0 - 2.0 * {ratio} * {body})"
