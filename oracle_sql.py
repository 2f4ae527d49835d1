"""DuckDB oracle SQL for the registered queries (the correctness gate).

Written independently of the Spark code: plain windows over whole keys, no
chunking.  The driver's tables are pre-registered views.  Role CTEs mirror
FIXTURES.md Part 2.
"""

from __future__ import annotations

from gridpv.catalog import NATIONS

ROLES = {
    "r1": """r1 AS (
  SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) AS datetime_gmt,
         avg(CASE WHEN event_id % 5 <> 0 THEN value END) AS generation_mw
  FROM events GROUP BY 1, 2)""",
    "r2": """r2 AS (
  SELECT user_id AS gsp_id, ts AS datetime_gmt, event_id,
         CASE WHEN event_type = 'error' THEN NULL
              WHEN event_type = 'purchase' OR event_id % 17 = 0 THEN value END AS generation_mw
  FROM events)""",
    "r3": """r3 AS (
  SELECT s_nationkey AS gsp_id, l_shipdate AS datetime_gmt, sum(l_quantity) AS generation_mw
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)""",
    "r4": """r4m AS (
  SELECT n_nationkey, n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS install_month,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS _cents, count(*) AS system_count
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
r4 AS (
  SELECT install_month,
         CASE WHEN n_nationkey = 24 THEN 'unkown' ELSE n_name END AS "GSPs",
         CAST(sum(_cents) OVER (PARTITION BY n_nationkey ORDER BY install_month
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) / 1e8::DOUBLE AS cumul_capacity_mwp,
         system_count
  FROM r4m)""",
    "r5": """r5 AS (
  SELECT CASE WHEN n_nationkey % 11 = 10 THEN 'n/a' ELSE CAST(n_nationkey AS VARCHAR) END AS gsp_id,
         '  ' || lower(n_name) || ' ' AS gsp_name,
         50.0::DOUBLE + 0.25::DOUBLE * n_nationkey + CAST(ro - 1 AS DOUBLE) AS gsp_lat,
         -5.0::DOUBLE + 0.25::DOUBLE * n_nationkey + CAST(ro - 1 AS DOUBLE) AS gsp_lon,
         r_name AS region_name, CAST(10 + n_regionkey AS INTEGER) AS pes_id, CAST(ro AS BIGINT) AS row_ord
  FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1, 2]) AS ro) t)""",
    "known": """known AS (SELECT DISTINCT CAST(s_nationkey AS INTEGER) AS gsp_id FROM supplier)""",
    "r6": """r6 AS (
  SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS date,
         round(avg(k), 6) AS shortwave_radiation,
         round(min(k), 6) AS direct_radiation,
         round(max(k) - min(k), 6) AS diffuse_radiation,
         round(avg(value), 6) AS direct_normal_irradiance,
         round(sum(k), 6) AS global_tilted_irradiance,
         round(max(value), 6) AS shortwave_radiation_instant,
         round(min(value), 6) AS direct_radiation_instant,
         round(CAST(count(*) AS DOUBLE), 6) AS diffuse_radiation_instant,
         round(sum(value), 6) AS direct_normal_irradiance_instant,
         round(max(k), 6) AS global_tilted_irradiance_instant
  FROM (SELECT *, CAST(props->>'k' AS DOUBLE) AS k FROM events) GROUP BY 1, 2)""",
    "r8": """r8 AS (
  SELECT event_type, ts AS datetime_gmt, event_id, value AS generation_mw,
         CAST(props->>'k' AS DOUBLE) AS pred_generation_mw
  FROM events)""",
}

WEATHER = [
    "shortwave_radiation",
    "direct_radiation",
    "diffuse_radiation",
    "direct_normal_irradiance",
    "global_tilted_irradiance",
    "shortwave_radiation_instant",
    "direct_radiation_instant",
    "diffuse_radiation_instant",
    "direct_normal_irradiance_instant",
    "global_tilted_irradiance_instant",
]


def scaled_round(sql: str) -> str:
    """Rewrite every ``round(x, p)`` as ``round((x) * 1eP) / 1eP``, the rounding the
    Spark side uses (ties resolve the same way in both engines)."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        inner = sql[j + 6:k]
        if comma < 0 or not sql[comma + 1:k].strip().isdigit():
            out.append(sql[i:j] + "round(" + scaled_round(inner) + ")")
        else:
            p = int(sql[comma + 1:k].strip())
            out.append(sql[i:j] + f"(round(({scaled_round(sql[j + 6:comma])}) * 1e{p}) / 1e{p})")
        i = k + 1


def with_ctes(ctes: list[str], body: str) -> str:
    parts = [ROLES.get(c, c) for c in ctes]
    return scaled_round("WITH " + ",\n".join(parts) + "\n" + body)


def fill_cte(name: str, src: str, keys: list[str], ts: str, col: str, mode: str,
             limit: int | None = None, tiebreak: tuple[str, ...] = ()) -> str:
    """CTEs named ``{name}`` = ``src`` with ``col`` filled.

    ``mode``: ``time`` (G1), ``linear`` (G2, x = row number), ``ffill`` (G3),
    ``ffill_bfill`` (G4).  Whole-key windows; the next present value comes from
    a descending frame.
    """
    pk = ", ".join(keys)
    order = ", ".join([ts, *tiebreak])
    x_t = f"epoch_us({ts})"
    present = f"{col} IS NOT NULL"
    wf = f"(PARTITION BY {pk} ORDER BY _rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wb = f"(PARTITION BY {pk} ORDER BY _rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def lv(expr: str, w: str) -> str:
        return f"last_value(CASE WHEN {present} THEN {expr} END IGNORE NULLS) OVER {w}"

    if mode == "ffill":
        filled = f"coalesce({col}, _p_v)"
    elif mode == "ffill_bfill":
        filled = f"coalesce({col}, _p_v, _q_v)"
    else:
        if limit is None:
            ok = "(_p_rn IS NOT NULL OR _q_rn IS NOT NULL)"
        else:
            ok = f"((_p_rn IS NOT NULL AND _rn - _p_rn <= {limit}) OR (_q_rn IS NOT NULL AND _q_rn - _rn <= {limit}))"
        if mode == "time":
            line = f"_p_v + (_q_v - _p_v) * ({x_t} - _p_t) / (_q_t - _p_t)"
        else:
            line = "_p_v + (_q_v - _p_v) * (_rn - _p_rn) / (_q_rn - _p_rn)"
        filled = (
            f"CASE WHEN {col} IS NOT NULL THEN {col} WHEN NOT {ok} THEN NULL "
            f"WHEN _p_rn IS NOT NULL AND _q_rn IS NOT NULL THEN {line} "
            f"WHEN _p_rn IS NOT NULL THEN _p_v ELSE _q_v END"
        )
    return f"""{name}_i AS (
  SELECT *, row_number() OVER (PARTITION BY {pk} ORDER BY {order}) AS _rn FROM {src}),
{name}_n AS (
  SELECT *, {lv('_rn', wf)} AS _p_rn, {lv(x_t, wf)} AS _p_t, {lv(col, wf)} AS _p_v,
            {lv('_rn', wb)} AS _q_rn, {lv(x_t, wb)} AS _q_t, {lv(col, wb)} AS _q_v
  FROM {name}_i),
{name}_f AS (SELECT * EXCLUDE ({col}), {filled} AS {col} FROM {name}_n),
{name} AS (SELECT * EXCLUDE (_rn, _p_rn, _p_t, _p_v, _q_rn, _q_t, _q_v) FROM {name}_f)"""


def grid_cte(name: str, src: str, keys: list[str], ts: str, step: str) -> str:
    """CTE ``{name}``: every ``min + k*step`` to ``max`` of ``ts`` per key."""
    pk = ", ".join(keys)
    return f"""{name}_x AS (SELECT {pk}, min({ts}) AS _lo, max({ts}) AS _hi FROM {src} WHERE {ts} IS NOT NULL GROUP BY ALL),
{name} AS (SELECT {pk}, unnest(generate_series(_lo, _hi, INTERVAL '{step}')) AS {ts} FROM {name}_x)"""


# --------------------------------------------------------------------------- shared CTEs

NORM = r"upper(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"

MERGED = [
    "r4", "r5", "known",
    """cap AS (SELECT 'R4' AS release, install_month, "GSPs", cumul_capacity_mwp, system_count FROM r4
  WHERE install_month IS NOT NULL AND "GSPs" IS NOT NULL AND cumul_capacity_mwp IS NOT NULL
    AND NOT isnan(cumul_capacity_mwp) AND system_count IS NOT NULL)""",
    """locn AS (SELECT CAST(trunc(TRY_CAST(gsp_id AS DOUBLE)) AS INTEGER) AS gsp_id, gsp_name, gsp_lat, gsp_lon,
  region_name, pes_id, row_ord FROM r5 WHERE TRY_CAST(gsp_id AS DOUBLE) IS NOT NULL)""",
    "lk AS (SELECT * FROM locn WHERE gsp_id IN (SELECT gsp_id FROM known))",
    f"""ldd AS (SELECT * EXCLUDE (_r) FROM (SELECT {NORM.format(c='gsp_name')} AS _k, *,
  row_number() OVER (PARTITION BY {NORM.format(c='gsp_name')} ORDER BY row_ord) AS _r FROM lk) WHERE _r = 1)""",
    f"""merged AS (SELECT c.*, l.gsp_id, l.gsp_lat, l.gsp_lon, l.region_name, l.pes_id FROM cap c
  LEFT JOIN ldd l ON {NORM.format(c='c."GSPs"')} = l._k
  WHERE l.gsp_id IS NOT NULL AND l.gsp_lat IS NOT NULL AND l.gsp_lon IS NOT NULL AND l.region_name IS NOT NULL
    AND l.pes_id IS NOT NULL AND c."GSPs" <> 'unkown')""",
]

GL = MERGED + [
    """gl AS (SELECT "GSPs", arg_min(gsp_id, install_month) AS gsp_id, arg_min(gsp_lat, install_month) AS gsp_lat,
  arg_min(gsp_lon, install_month) AS gsp_lon, arg_min(region_name, install_month) AS region_name,
  arg_min(pes_id, install_month) AS pes_id FROM merged GROUP BY 1)""",
    """glb AS (SELECT *, "GSPs" || ' | ' || region_name AS "GSP_region" FROM gl)""",
]

CAPM = MERGED + [
    """capm AS (SELECT gsp_id, CAST(install_month AS TIMESTAMP) AS install_month, cumul_capacity_mwp, "GSPs",
  gsp_lat, gsp_lon, region_name, pes_id,
  CAST(year(install_month) AS INTEGER) AS year, CAST(month(install_month) AS INTEGER) AS month,
  CAST(day(install_month) AS INTEGER) AS day, CAST(0 AS INTEGER) AS hour FROM merged)""",
]

CELLS = MERGED + ["""cells AS (SELECT install_month, "GSPs", min(cumul_capacity_mwp) AS cumul_capacity_mwp
  FROM merged WHERE cumul_capacity_mwp IS NOT NULL GROUP BY 1, 2)"""]

SCORED = ["r8", """scored AS (SELECT *, pred_generation_mw * 10.0::DOUBLE AS global_tilted_irradiance_instant,
  CAST(event_id AS DOUBLE) / 100.0::DOUBLE AS capacity_mwp FROM r8)"""]

K = ["event_type"]
TS = "datetime_gmt"
TSM = "CAST(install_month AS TIMESTAMP) AS install_month"


def reg_r1() -> list[str]:
    return [
        "r1",
        grid_cte("grid", "r1", K, TS, "30 minutes"),
        "reg AS (SELECT g.event_type, g.datetime_gmt, r1.generation_mw FROM grid g "
        "LEFT JOIN r1 USING (event_type, datetime_gmt))",
    ]


def cal_parts(ts: str) -> str:
    return (f"CAST(year({ts}) AS INTEGER) AS year, CAST(month({ts}) AS INTEGER) AS month, "
            f"CAST(day({ts}) AS INTEGER) AS day, CAST(hour({ts}) AS INTEGER) AS hour")


def resample_sql(src: str, unit: str, out: str, sums: dict[str, str], means: dict[str, str]) -> tuple[list, str]:
    """Per key period sums (0 when empty) and means on a complete calendar."""
    step = {"hour": "1 hour", "day": "1 day"}[unit]
    aggs = ", ".join([f"sum({c}) AS {n}" for c, n in sums.items()] + [f"avg({c}) AS {n}" for c, n in means.items()])
    ctes = [
        f"agg AS (SELECT event_type, date_trunc('{unit}', {TS}) AS {out}, {aggs} FROM {src} GROUP BY 1, 2)",
        grid_cte("cal", "agg", K, out, step),
    ]
    cols = ", ".join([f"round(coalesce(a.{n}, 0.0), 6) AS {n}" for n in sums.values()]
                     + [f"round(a.{n}, 6) AS {n}" for n in means.values()])
    body = f"SELECT c.event_type, c.{out}, {cols} FROM cal c LEFT JOIN agg a USING (event_type, {out})"
    return ctes, body


PROFILE_SUMS = {"generation_mw": "actual_generation_mw", "pred_generation_mw": "pred_generation_mw"}
PROFILE_MEANS = {"global_tilted_irradiance_instant": "global_tilted_irradiance_instant"}


def split_cte(src: str, name: str = "sp") -> str:
    h = "md5(concat_ws('|', event_type, CAST(epoch_us(datetime_gmt) AS VARCHAR), '101'))"
    return f"""{name} AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY {h}, datetime_gmt, event_id)
  <= ceil(count(*) OVER (PARTITION BY event_type) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM {src})"""


def last_period_cte(src: str, keys: list[str], unit: str, name: str) -> str:
    pk = ", ".join(keys)
    return f"""{name} AS (SELECT s.* FROM {src} s JOIN (SELECT {pk}, date_trunc('{unit}', max({TS})) AS _lp FROM {src} GROUP BY ALL) m
  USING ({pk}) WHERE date_trunc('{unit}', s.{TS}) = m._lp)"""


WX = ["r6", """wdays AS (SELECT DISTINCT event_type, date_trunc('day', date) AS d FROM r6)""",
      """whrs AS (SELECT event_type, d + to_hours(h) AS date FROM wdays, range(24) t(h))""",
      "wx AS (SELECT h.event_type, h.date, "
      + ", ".join(f"CAST(CAST(r6.{v} AS FLOAT) AS DOUBLE) AS {v}" for v in WEATHER)
      + ", " + cal_parts("h.date") + " FROM whrs h LEFT JOIN r6 USING (event_type, date))"]


def k3_sql(zero: bool, method: str | None = None, locations: bool = False) -> str:
    ctes = ["r3"] + (GL if locations else MERGED) + CAPM[len(MERGED):] + [
        f"g AS (SELECT gsp_id, {TS}, generation_mw, CAST(year({TS}) AS INTEGER) AS year, "
        f"CAST(month({TS}) AS INTEGER) AS month FROM r3)",
        "capg AS (SELECT gsp_id, year, month, arg_max(cumul_capacity_mwp, install_month) AS capacity_mwp "
        "FROM capm GROUP BY ALL)",
        f"ga AS (SELECT g.gsp_id, g.{TS}, g.generation_mw, c.capacity_mwp FROM g LEFT JOIN capg c USING (gsp_id, year, month))",
        fill_cte("ff", "ga", ["gsp_id"], TS, "capacity_mwp", "ffill"),
        grid_cte("kgrid", "ga", ["gsp_id"], TS, "1 day"),
        f"kreg AS (SELECT kgrid.gsp_id, kgrid.{TS}, ff.generation_mw, ff.capacity_mwp FROM kgrid "
        f"LEFT JOIN ff USING (gsp_id, {TS}))",
    ]
    method = method or ("zero" if zero else "interpolate")
    if method == "none":
        ctes.append("i2 AS (SELECT * FROM kreg)")
    elif method == "zero":
        ctes.append(f"i2 AS (SELECT gsp_id, {TS}, coalesce(generation_mw, 0.0) AS generation_mw, "
                    f"coalesce(capacity_mwp, 0.0) AS capacity_mwp FROM kreg)")
    else:
        ctes += [fill_cte("i1", "kreg", ["gsp_id"], TS, "generation_mw", "linear"),
                 fill_cte("i2", "i1", ["gsp_id"], TS, "capacity_mwp", "linear")]
    if locations:
        # Location columns are constant per id, so carrying them forward onto new
        # grid rows equals joining them on the id.
        ctes.append('i3 AS (SELECT i2.*, g."GSPs", g.gsp_lat, g.gsp_lon, g.region_name, g.pes_id, g."GSP_region" '
                    'FROM i2 LEFT JOIN glb g USING (gsp_id))')
        return with_ctes(ctes, f"SELECT gsp_id, {TS}, round(generation_mw, 6) AS generation_mw, "
                               f"round(capacity_mwp, 6) AS capacity_mwp, {cal_parts(TS)}, \"GSPs\", "
                               "round(gsp_lat, 6) AS gsp_lat, round(gsp_lon, 6) AS gsp_lon, region_name, pes_id, "
                               "\"GSP_region\" FROM i3")
    return with_ctes(ctes, f"SELECT gsp_id, {TS}, round(generation_mw, 6) AS generation_mw, "
                           f"round(capacity_mwp, 6) AS capacity_mwp, {cal_parts(TS)} FROM i2")


# --------------------------------------------------------------------------- queries


def _entry_sql() -> str:
    return with_ctes(
        reg_r1()
        + [
            fill_cte("f", "reg", K, TS, "generation_mw", "time", limit=12),
            "hourly AS (SELECT event_type, date_trunc('hour', datetime_gmt) AS datetime_gmt, "
            "avg(generation_mw) AS generation_mw FROM f GROUP BY ALL)",
            "daily AS (SELECT event_type, date_trunc('day', datetime_gmt) AS date, "
            "sum(generation_mw) AS generation_mw FROM hourly GROUP BY ALL)",
            grid_cte("cal", "daily", K, "date", "1 day"),
        ],
        "SELECT c.event_type, c.date, round(coalesce(d.generation_mw, 0.0), 6) AS generation_mw "
        "FROM cal c LEFT JOIN daily d USING (event_type, date)",
    )


def _r1_fill(mode: str, limit: int | None = None) -> str:
    return with_ctes(reg_r1() + [fill_cte("f", "reg", K, TS, "generation_mw", mode, limit=limit)],
                     f"SELECT event_type, {TS}, round(generation_mw, 6) AS generation_mw FROM f")


def _r2_fill(mode: str, limit: int | None = None) -> str:
    return with_ctes(["r2", fill_cte("f", "r2", ["gsp_id"], TS, "generation_mw", mode, limit, ("event_id",))],
                     f"SELECT gsp_id, {TS}, event_id, round(generation_mw, 6) AS generation_mw FROM f")


def _profile(unit: str, out: str, src_ctes: list[str], src: str) -> str:
    ctes, body = resample_sql(src, unit, out, PROFILE_SUMS, PROFILE_MEANS)
    return with_ctes(src_ctes + ctes, body)


# Request parameter cases for the manifest query (same as the Spark side).
A2_CASES = [
    ("gsp", True, False, "20250101"),
    ("gsp", True, True, "20220314"),
    ("gsp", False, False, "20990101"),
    ("llsoa", True, False, "20250101"),
    ("pes", False, True, "20250101"),
    ("nowhere", True, False, "20250101"),
]


def _a2_sql() -> str:
    man = """man AS (SELECT p_size AS release_ord, 'release_' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS release,
  p_partkey AS file_ord,
  replace(p_name, ' ', '_') || '_capacity_by_' ||
    CASE p_type WHEN 'ECONOMY' THEN '20250101_GSP' WHEN 'STANDARD' THEN '20220314_GSP' WHEN 'SMALL' THEN 'llsoa'
                WHEN 'MEDIUM' THEN 'gsp' ELSE 'pes' END ||
    CASE WHEN p_retailprice < 950 THEN '_and_month' ELSE '' END ||
    CASE WHEN ends_with(p_brand, '7') THEN '_and_system_size' ELSE '' END || '.csv.gz' AS filename
  FROM part)"""
    man2 = "man2 AS (SELECT *, 'file:///capacity/' || release || '/' || filename AS url FROM man)"
    parts = []
    for i, (region, hist, size, bv) in enumerate(A2_CASES):
        tok = f"{bv}_GSP" if region == "gsp" else region
        target = f"_capacity_by_{tok}" + ("_and_month" if hist else "") + ("_and_system_size" if size else "")
        tier = (f"CASE WHEN contains(filename, '{target}') THEN 1 "
                f"WHEN contains(filename, '_capacity_by_') AND (contains(filename, '{tok}') OR "
                f"contains(filename, '_capacity_by_{region}')) THEN 2 "
                f"WHEN contains(filename, '_capacity_by_') AND contains(filename, '{region}') THEN 3 END")
        parts.append(f"""(SELECT release, filename, url, tier, CAST({i} AS INTEGER) AS case_id FROM
  (SELECT *, {tier} AS tier FROM man2) WHERE tier IS NOT NULL ORDER BY release_ord, tier, file_ord LIMIT 1)""")
    return with_ctes([man, man2], "\nUNION ALL\n".join(parts))


def _null_profile_sql() -> str:
    cols = ["gsp_id", "datetime_gmt", "event_id", "generation_mw"]
    anyrow = " OR ".join(f"{c} IS NULL" for c in cols)
    sel = []
    for c in cols:
        sel.append(f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
                   f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 0 AS any_missing, "
                   f"CAST(sum(CASE WHEN {anyrow} THEN 1 ELSE 0 END) AS BIGINT) AS rows_with_missing, "
                   f"count(*) AS n_rows FROM r2")
    return with_ctes(["r2"], "\nUNION ALL\n".join(sel))


C8_CTES = [
    """req AS (SELECT s_suppkey AS request_id, CASE WHEN s_acctbal < 0 THEN NULL ELSE n_name || ' | ' || r_name END
  AS gsp_region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    """lab AS (SELECT "GSP_region" AS _label, arg_min(CAST(gsp_id AS VARCHAR), "GSPs") AS _raw FROM glb GROUP BY 1)""",
    """rs AS (SELECT r.*, l._label, l._raw, TRY_CAST(l._raw AS DOUBLE) AS _d FROM req r LEFT JOIN lab l ON r.gsp_region = l._label)""",
    """rs2 AS (SELECT *, CASE WHEN gsp_region IS NULL THEN 'No GSP_region provided.'
  WHEN _label IS NULL THEN 'GSP_region ''' || gsp_region || ''' not found.'
  WHEN _d IS NULL OR _d <> floor(_d) THEN 'gsp_id for ''' || gsp_region || ''' is not convertible to int: ' || _raw
  ELSE 'ok' END AS status FROM rs)""",
]


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_daily_generation"] = _entry_sql()
    q["g1_interpolate_time"] = _r2_fill("time", 12)
    q["g1_grid_limit2"] = _r1_fill("time", 2)
    q["g2_interpolate_linear"] = _r1_fill("linear")
    q["g3_ffill"] = _r1_fill("ffill")
    q["g4_ffill_bfill"] = _r2_fill("ffill_bfill")
    q["g6_time_grid"] = with_ctes(reg_r1(), f"SELECT event_type, {TS} FROM grid")
    q["d4_regularize"] = with_ctes(reg_r1(), f"SELECT event_type, {TS}, round(generation_mw, 6) AS generation_mw FROM reg")
    q["d7_missing_slots"] = with_ctes(
        reg_r1(), f"SELECT g.event_type, g.{TS} FROM grid g WHERE NOT EXISTS "
        f"(SELECT 1 FROM r1 WHERE r1.event_type = g.event_type AND r1.{TS} = g.{TS})")
    q["d7_missing_slots_period"] = with_ctes(
        ["r1", "pk AS (SELECT DISTINCT event_type FROM r1)",
         f"pg AS (SELECT event_type, unnest(generate_series(TIMESTAMP '2024-01-10 00:00:00', "
         f"TIMESTAMP '2024-01-20 23:30:00', INTERVAL '30 minutes')) AS {TS} FROM pk)"],
        f"SELECT g.event_type, g.{TS} FROM pg g WHERE NOT EXISTS "
        f"(SELECT 1 FROM r1 WHERE r1.event_type = g.event_type AND r1.{TS} = g.{TS})")
    q["f1_to_hourly"] = with_ctes(
        reg_r1(), f"SELECT event_type, date_trunc('hour', {TS}) AS {TS}, round(avg(generation_mw), 6) AS generation_mw "
        f"FROM reg GROUP BY 1, 2")
    q["g8_nth_from_end"] = with_ctes(
        SCORED, f"SELECT event_type, {TS}, event_id, round(capacity_mwp, 6) AS capacity_mwp FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {TS} DESC, event_id DESC) AS _r FROM scored) "
        f"WHERE _r = 50")
    q["c14_trailing"] = with_ctes(
        ["r2"], f"SELECT r.gsp_id, r.{TS}, r.event_id, round(r.generation_mw, 6) AS generation_mw FROM r2 r "
        f"JOIN (SELECT gsp_id, max({TS}) AS _l FROM r2 GROUP BY 1) m USING (gsp_id) WHERE r.{TS} >= m._l - INTERVAL 7 DAY")
    q["f2_daily_profile"] = _profile("day", "date", SCORED, "scored")
    q["f3_hourly_profile"] = _profile("hour", "hour", SCORED, "scored")
    q["f6_kpis"] = with_ctes(
        SCORED, "SELECT event_type, round(a, 6) AS total_generation_mw, round(p, 6) AS total_predicted_generation_mw, "
        "round((p - a) / NULLIF(a, 0.0) * 100.0, 6) AS percent_variance FROM "
        "(SELECT event_type, coalesce(sum(generation_mw), 0.0) AS a, coalesce(sum(pred_generation_mw), 0.0) AS p "
        "FROM scored GROUP BY 1)")
    q["c11_last_month"] = with_ctes(
        ["r3", last_period_cte("r3", ["gsp_id"], "month", "lm")],
        f"SELECT gsp_id, {TS}, round(generation_mw, 6) AS generation_mw FROM lm")
    q["c12_last_day"] = with_ctes(
        SCORED + [last_period_cte("scored", K, "day", "ld")],
        f"SELECT event_type, {TS}, event_id, round(generation_mw, 6) AS generation_mw FROM ld")
    ctes, body = resample_sql("lm", "day", "date", PROFILE_SUMS, PROFILE_MEANS)
    q["k6_last_month_daily"] = with_ctes(
        SCORED + [last_period_cte("scored", K, "month", "lm")] + ctes + [f"prof AS ({body})"],
        "SELECT *, strftime(date, '%Y-%m') AS period FROM prof")
    ctes, body = resample_sql("ld", "hour", "hour", PROFILE_SUMS, PROFILE_MEANS)
    q["k7_last_day_hourly"] = with_ctes(SCORED + [last_period_cte("scored", K, "day", "ld")] + ctes, body)
    q["k8_kpi_row"] = with_ctes(
        SCORED + [
            "kp AS (SELECT event_type, coalesce(sum(generation_mw), 0.0) AS a, coalesce(sum(pred_generation_mw), 0.0) AS p "
            "FROM scored GROUP BY 1)",
            f"nth AS (SELECT event_type, capacity_mwp FROM (SELECT *, row_number() OVER (PARTITION BY event_type "
            f"ORDER BY {TS} DESC, event_id DESC) AS _r FROM scored) WHERE _r = 50)"],
        "SELECT kp.event_type, round(a, 6) AS total_generation_mw, round(p, 6) AS total_predicted_generation_mw, "
        "round((p - a) / NULLIF(a, 0.0) * 100.0, 6) AS percent_variance, round(nth.capacity_mwp, 6) AS last_capacity_mwp "
        "FROM kp LEFT JOIN nth USING (event_type)")
    q["k12_error_heatmap"] = with_ctes(
        SCORED + ["df AS (SELECT *, pred_generation_mw - generation_mw AS difference FROM scored)"],
        f"SELECT event_type, date_trunc('day', {TS}) AS time_bin, floor(difference / 10.0) * 10.0 AS difference_bin, "
        "round(sum(difference), 6) AS sum_difference, count(*) AS n FROM df WHERE difference IS NOT NULL GROUP BY 1, 2, 3")
    q["j1_split"] = with_ctes(SCORED + [split_cte("scored")], f"SELECT event_type, {TS}, event_id, split FROM sp")
    q["j2_scale"] = with_ctes(
        SCORED + [split_cte("scored"),
                  "st AS (SELECT event_type, avg(generation_mw) AS mg, stddev_pop(generation_mw) AS sg, "
                  "avg(pred_generation_mw) AS mp, stddev_pop(pred_generation_mw) AS spp FROM sp WHERE split = 'train' GROUP BY 1)"],
        f"SELECT sp.event_type, sp.{TS}, sp.event_id, sp.split, "
        "round((generation_mw - mg) / NULLIF(sg, 0.0), 6) AS generation_mw, "
        "round((pred_generation_mw - mp) / NULLIF(spp, 0.0), 6) AS pred_generation_mw FROM sp LEFT JOIN st USING (event_type)")
    q["f15_regression_metrics"] = with_ctes(
        SCORED + [split_cte("scored")],
        "SELECT event_type, split, count(*) AS n, "
        "round(1.0 - sum((pred_generation_mw - generation_mw) ^ 2) / (var_pop(generation_mw) * count(*)), 3) AS r2, "
        "round(avg(abs(pred_generation_mw - generation_mw)), 3) AS mae, "
        "round(avg((pred_generation_mw - generation_mw) ^ 2), 3) AS mse, "
        "round(sqrt(avg((pred_generation_mw - generation_mw) ^ 2)), 3) AS rmse "
        "FROM sp WHERE generation_mw IS NOT NULL AND pred_generation_mw IS NOT NULL GROUP BY 1, 2")
    q["k1_capacity_with_locations"] = with_ctes(MERGED, f"SELECT * REPLACE ({TSM}) FROM merged")
    q["e2_gsp_locations"] = with_ctes(GL, "SELECT * FROM glb")
    q["c6_keep_known"] = with_ctes(MERGED, "SELECT * FROM lk")
    q["c7_unknown_ids"] = with_ctes(
        ["r2"] + GL, "SELECT DISTINCT CAST(gsp_id AS INTEGER) AS gsp_id FROM r2 WHERE gsp_id IS NOT NULL "
        "AND CAST(gsp_id AS INTEGER) NOT IN (SELECT gsp_id FROM glb)")
    q["e3_distinct_ids"] = with_ctes(["r2"], "SELECT DISTINCT gsp_id FROM r2 WHERE generation_mw IS NOT NULL AND gsp_id IS NOT NULL")
    q["c8_resolve_labels"] = with_ctes(
        GL + C8_CTES,
        "SELECT request_id, gsp_region, CASE WHEN status = 'ok' THEN CAST(_d AS INTEGER) END AS gsp_id, status FROM rs2")
    q["c3_validate_periods"] = with_ctes(
        ["""req AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, CAST(l_shipdate AS DATE) AS start_date,
  CAST(CAST(o_orderdate AS DATE) + 40 AS DATE) AS end_date FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""",
         """b AS (SELECT *, CAST(start_date AS TIMESTAMP) AS start_dt,
  CAST(end_date AS TIMESTAMP) + INTERVAL 1410 MINUTE AS end_dt FROM req)"""],
        "SELECT * REPLACE (CAST(start_date AS TIMESTAMP) AS start_date, CAST(end_date AS TIMESTAMP) AS end_date), "
        "CASE WHEN end_dt < start_dt THEN 'End date must not be before start date.' "
        "WHEN end_dt < start_dt + INTERVAL 1 MONTH THEN 'End date must be at least 1 month(s) after start date.' "
        "ELSE 'ok' END AS status FROM b")
    q["a2_choose_release"] = _a2_sql()
    q["a4_select_generation"] = with_ctes(
        ["r2", "known"], f"SELECT gsp_id, {TS}, round(generation_mw, 6) AS generation_mw FROM r2 "
        f"WHERE {TS} BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:30:00' AND gsp_id >= 1 "
        "AND gsp_id IN (SELECT gsp_id FROM known)")
    q["a7_explode_weather"] = with_ctes(
        WX, "SELECT event_type, date, " + ", ".join(f"round({v}, 6) AS {v}" for v in WEATHER)
        + ", year, month, day, hour FROM wx")
    k2 = ["r2"] + GL + [fill_cte("f", "r2", ["gsp_id"], TS, "generation_mw", "time", 12, ("event_id",)),
                        "k2 AS (SELECT CAST(f.gsp_id AS INTEGER) AS gsp_id, f.datetime_gmt, f.event_id, f.generation_mw, "
                        "g.\"GSPs\", g.gsp_lat, g.gsp_lon, g.region_name, g.pes_id, g.\"GSP_region\" FROM f "
                        "LEFT JOIN glb g ON CAST(f.gsp_id AS INTEGER) = g.gsp_id)"]
    q["k2_clean_generation"] = with_ctes(
        k2, "SELECT * REPLACE (round(generation_mw, 6) AS generation_mw, round(gsp_lat, 6) AS gsp_lat, "
        "round(gsp_lon, 6) AS gsp_lon) FROM k2")
    q["a8_weather_requests"] = with_ctes(
        k2, f"SELECT gsp_id, round(arg_min(gsp_lat, CASE WHEN gsp_lat IS NOT NULL AND gsp_lon IS NOT NULL THEN {TS} END), 6) AS latitude, "
        f"round(arg_min(gsp_lon, CASE WHEN gsp_lat IS NOT NULL AND gsp_lon IS NOT NULL THEN {TS} END), 6) AS longitude, "
        f"strftime(min({TS}), '%Y-%m-%d') AS start_date, strftime(max({TS}), '%Y-%m-%d') AS end_date FROM k2 GROUP BY 1")
    q["k3_generation_with_capacity"] = k3_sql(zero=False)
    q["k3_zero_fill"] = k3_sql(zero=True)
    capg = ("capg AS (SELECT gsp_id, year, month, arg_max(cumul_capacity_mwp, install_month) AS capacity_mwp "
            "FROM capm GROUP BY ALL)")
    q["k3_with_locations"] = k3_sql(zero=False, locations=True)
    q["k3_no_fill"] = k3_sql(zero=False, method="none")
    q["k13_quality_report"] = scaled_round(
        f"WITH k3 AS ({k3_sql(zero=False, method='none')})\n"
        + "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
            f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 0 AS any_missing, "
            "CAST(sum(CASE WHEN gsp_id IS NULL OR datetime_gmt IS NULL OR generation_mw IS NULL OR capacity_mwp IS NULL "
            "THEN 1 ELSE 0 END) AS BIGINT) AS rows_with_missing, count(*) AS n_rows FROM k3"
            for c in ["gsp_id", "datetime_gmt", "generation_mw", "capacity_mwp"]))
    q["f7_time_extents"] = with_ctes(["r2"], f"SELECT gsp_id, min({TS}) AS first_ts, max({TS}) AS last_ts FROM r2 GROUP BY 1")
    q["d3_align_capacity"] = with_ctes(
        ["r3"] + CAPM + [capg, f"g AS (SELECT gsp_id, {TS}, generation_mw, {cal_parts(TS)} FROM r3)"],
        "SELECT g.*, round(c.capacity_mwp, 6) AS capacity_mwp FROM g LEFT JOIN capg c USING (gsp_id, year, month)")
    q["k4_capacity_calendar"] = with_ctes(CAPM, "SELECT * FROM capm")
    q["k5_modelling_table"] = with_ctes(
        WX + reg_r1() + CELLS + [
            "capm AS (SELECT month(install_month) AS m, sum(cumul_capacity_mwp) AS capacity_mwp FROM cells GROUP BY 1)",
            fill_cte("f", "reg", K, TS, "generation_mw", "time", limit=12),
            f"hr AS (SELECT event_type, date_trunc('hour', {TS}) AS date, avg(generation_mw) AS generation_mw, "
            f"avg(k.capacity_mwp) AS capacity_mwp FROM f LEFT JOIN capm k ON k.m = month(f.{TS}) GROUP BY 1, 2)",
            "j AS (SELECT w.*, hr.generation_mw, hr.capacity_mwp FROM wx w LEFT JOIN hr USING (event_type, date))",
            fill_cte("m1", "j", K, "date", "generation_mw", "linear"),
            fill_cte("m2", "m1", K, "date", "capacity_mwp", "linear")],
        "SELECT event_type, date, " + ", ".join(f"round({v}, 6) AS {v}" for v in WEATHER)
        + ", year, month, day, hour, round(generation_mw, 6) AS generation_mw, round(capacity_mwp, 6) AS capacity_mwp FROM m2")
    names = ", ".join(f"""max(cumul_capacity_mwp) FILTER (WHERE "GSPs" = '{n}') AS "{n}\"""" for n in NATIONS)
    q["i1_wide_capacity"] = with_ctes(CELLS, f"SELECT {TSM}, {names} FROM cells GROUP BY install_month")
    q["i2_long_capacity"] = with_ctes(CELLS, f"SELECT * REPLACE ({TSM}) FROM cells")
    loc_map = ("SELECT g.*, c.cumul_capacity_mwp AS latest_capacity_mwp FROM glb g LEFT JOIN "
               "(SELECT * FROM {src} WHERE install_month = (SELECT max(install_month) FROM {src})) c USING (\"GSPs\")")
    q["k9_location_map"] = with_ctes(GL + CELLS[len(MERGED):], loc_map.format(src="cells"))
    q["k9_location_map_full_month"] = with_ctes(
        GL + CELLS[len(MERGED):] + ["cf AS (SELECT * FROM cells WHERE install_month < DATE '2001-08-01')"],
        loc_map.format(src="cf"))
    cf = CELLS + ["cf AS (SELECT * FROM cells WHERE install_month < DATE '2001-08-01')"]
    top = ("top AS (SELECT \"GSPs\", cumul_capacity_mwp FROM cs WHERE install_month = (SELECT max(install_month) FROM cs) "
           "ORDER BY cumul_capacity_mwp DESC NULLS LAST, \"GSPs\" LIMIT 10)")
    for suffix, base in (("", CELLS + ["cf AS (SELECT * FROM cells)"]), ("_full_month", cf)):
        q[f"f9_national_capacity{suffix}"] = with_ctes(
            base, "SELECT (SELECT count(DISTINCT \"GSPs\") FROM cf) AS gsp_count, "
            "CAST(trunc(coalesce(sum(cumul_capacity_mwp), 0.0) / 1000) AS BIGINT) AS total_solar_capacity_gwp "
            "FROM cf WHERE install_month = (SELECT max(install_month) FROM cf)")
        cs = base + ["cs AS (SELECT * FROM cf WHERE install_month >= DATE '1997-01-01')", top]
        q[f"h3_top_gsps{suffix}"] = with_ctes(cs, "SELECT \"GSPs\", cumul_capacity_mwp FROM top")
        q[f"k10_growth_top{suffix}"] = with_ctes(
            cs, "SELECT CAST(install_month AS TIMESTAMP) AS install_month, \"GSPs\", cumul_capacity_mwp FROM cs "
            "WHERE \"GSPs\" IN (SELECT \"GSPs\" FROM top)")
    q["c5_select_ids"] = with_ctes(
        ["r2"], "SELECT 'list' AS source, gsp_id, count(*) AS n_rows FROM r2 WHERE gsp_id IN (1, 2, 3) GROUP BY gsp_id "
        "UNION ALL SELECT 'table', gsp_id, count(*) FROM r2 WHERE gsp_id > 5 GROUP BY gsp_id")
    q["d5_half_hour_weather"] = with_ctes(
        WX + ["r1", f"hr AS (SELECT event_type, date_trunc('hour', {TS}) AS h, avg(generation_mw) AS generation_mw FROM r1 GROUP BY 1, 2)"],
        "SELECT w.event_type, w.date + m * INTERVAL 1 MINUTE AS date, round(w.shortwave_radiation, 6) AS shortwave_radiation, "
        "round(hr.generation_mw, 6) AS generation_mw FROM wx w CROSS JOIN (VALUES (10), (40)) o(m) "
        "LEFT JOIN hr ON hr.event_type = w.event_type AND hr.h = date_trunc('hour', w.date)")
    q["j11_residual_points"] = with_ctes(
        SCORED + [split_cte("scored")], "SELECT split, count(*) AS n, round(sum(generation_mw), 6) AS actual, "
        "round(sum(pred_generation_mw), 6) AS predicted FROM sp GROUP BY 1")
    r2 = ["r2", f"t AS (SELECT gsp_id, {TS}, generation_mw FROM r2)"]
    q["k13_null_profile"] = with_ctes(
        r2, " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) FILTER (WHERE {c} IS NULL) > 0 "
            f"AS any_missing, count(*) FILTER (WHERE gsp_id IS NULL OR {TS} IS NULL OR generation_mw IS NULL) AS rows_with_missing, "
            "count(*) AS n_rows FROM t" for c in ("gsp_id", TS, "generation_mw")))
    q["k13_nulls_by_month"] = with_ctes(
        r2, f"SELECT CAST(year({TS}) AS INTEGER) AS year, CAST(month({TS}) AS INTEGER) AS month, "
        "count(*) FILTER (WHERE generation_mw IS NULL) AS n_missing FROM t GROUP BY 1, 2")
    q["k13_rows_by_month"] = with_ctes(r2, f"SELECT strftime({TS}, '%Y-%m') AS month, count(*) AS n_rows FROM t GROUP BY 1")
    day = 86_400_000_000
    q["k13_completeness"] = with_ctes(
        r2, f"SELECT gsp_id, n AS n_rows, e AS expected_rows, m AS n_missing, n = e AND m = 0 AS complete FROM (SELECT gsp_id, count(*) AS n, "
        f"(epoch_us(max({TS})) - epoch_us(min({TS}))) // {day} + 1 AS e, count(*) FILTER (WHERE generation_mw IS NULL) AS m FROM t GROUP BY 1)")
    q["k13_missing_slots"] = with_ctes(
        r2 + [f"x AS (SELECT gsp_id, min({TS}) AS lo, max({TS}) AS hi FROM t GROUP BY 1)",
              f"g AS (SELECT gsp_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS {TS} FROM x)"],
        f"SELECT g.gsp_id, g.{TS} FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.gsp_id = g.gsp_id AND t.{TS} = g.{TS})")
    q["k13_incomplete_rows"] = with_ctes(
        r2, f"SELECT gsp_id, {TS}, round(generation_mw, 6) AS generation_mw FROM t WHERE gsp_id IS NULL OR {TS} IS NULL "
        f"OR generation_mw IS NULL ORDER BY gsp_id NULLS FIRST, {TS} NULLS FIRST LIMIT 20")
    q["k11_annual_capacity"] = with_ctes(
        CELLS + [
            "cy AS (SELECT *, CAST(year(install_month) AS INTEGER) AS year FROM cells WHERE install_month >= DATE '1997-01-01')",
            "ly AS (SELECT \"GSPs\", year, arg_max(cumul_capacity_mwp, install_month) AS v FROM cy GROUP BY 1, 2)",
            "tot AS (SELECT year, sum(v) AS t FROM ly GROUP BY 1)",
            "yrs AS (SELECT CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM cy)",
            "t2 AS (SELECT y.year, coalesce(t.t, 0.0) AS total_capacity_mwp FROM yrs y LEFT JOIN tot t USING (year))"],
        "SELECT year, round(coalesce(total_capacity_mwp - lag(total_capacity_mwp) OVER (ORDER BY year), 0.0), 6) "
        "AS annual_increase_mwp, round(total_capacity_mwp, 6) AS total_capacity_mwp FROM t2")
    q["f10_null_profile"] = _null_profile_sql()
    q["f11_nulls_by_month"] = with_ctes(
        ["r3"] + CAPM + [capg, f"g AS (SELECT gsp_id, {TS}, generation_mw, {cal_parts(TS)} FROM r3)",
                         "a AS (SELECT g.*, c.capacity_mwp FROM g LEFT JOIN capg c USING (gsp_id, year, month))"],
        f"SELECT CAST(year({TS}) AS INTEGER) AS year, CAST(month({TS}) AS INTEGER) AS month, "
        "CAST(sum(CASE WHEN capacity_mwp IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM a GROUP BY 1, 2")
    q["f12_rows_by_month"] = with_ctes(["r3"], f"SELECT strftime({TS}, '%Y-%m') AS month, count(*) AS n_rows FROM r3 GROUP BY 1")
    k3 = k3_sql(zero=False)
    span = f"(epoch_us(max({TS})) - epoch_us(min({TS}))) // 86400000000 + 1"
    q["f13_completeness"] = scaled_round(
        f"WITH k3 AS ({k3})\n"
        f"SELECT gsp_id, count(*) AS n_rows, CAST({span} AS BIGINT) AS expected_rows, "
        "CAST(sum(CASE WHEN generation_mw IS NULL THEN 1 ELSE 0 END) + "
        "sum(CASE WHEN capacity_mwp IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
        f"count(*) = {span} AND "
        "sum(CASE WHEN generation_mw IS NULL OR capacity_mwp IS NULL THEN 1 ELSE 0 END) = 0 AS complete FROM k3 GROUP BY 1")
    q["c13_incomplete_rows"] = with_ctes(
        ["r2"], f"SELECT gsp_id, {TS}, event_id, round(generation_mw, 6) AS generation_mw FROM r2 WHERE gsp_id IS NULL "
        f"OR {TS} IS NULL OR event_id IS NULL OR generation_mw IS NULL ORDER BY {TS}, event_id LIMIT 20")
    q["j4_root_splits"] = _root_splits_sql()
    q["h4_importance"] = (
        f"WITH root AS ({_root_splits_sql()}) SELECT e.event_type, f.feature, CASE WHEN root.feature = f.feature THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance "
        "FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN (VALUES ('irradiance'), ('hour'), ('day'), ('capacity_mwp')) f(feature) "
        "LEFT JOIN root ON root.event_type = e.event_type")
    q["a1_read_capacity"] = with_ctes(
        ["r4"], f"""SELECT 'R4' AS release, {TSM}, "GSPs", round(cumul_capacity_mwp * 1.25::DOUBLE, 6) AS dc_capacity_mwp,
        cumul_capacity_mwp, system_count FROM r4 WHERE system_count % 37 <> 0""")
    q["a3_read_locations"] = with_ctes(
        ["r5"], "SELECT gsp_id, gsp_name, round(gsp_lat, 6) AS gsp_lat, round(gsp_lon, 6) AS gsp_lon, region_name, pes_id FROM r5 WHERE row_ord = 1")
    q["a6_read_weather_payload"] = with_ctes(
        WX, "SELECT CAST(ascii(event_type) AS INTEGER) AS gsp_id, date, " + ", ".join(f"round({v}, 6) AS {v}" for v in WEATHER) + ", year, month, day, hour FROM wx")
    q["a9_write_table"] = with_ctes(
        ["r3"], f"SELECT gsp_id, {TS}, round(generation_mw, 6) AS generation_mw, CAST(year({TS}) AS INTEGER) AS year, fmt "
        "FROM r3, (VALUES ('parquet'), ('csv')) f(fmt)")
    q["e5_append_ordered"] = with_ctes(
        SCORED + [split_cte("scored")],
        f"SELECT event_type, {TS}, event_id, round(generation_mw, 6) AS generation_mw, split, "
        f"row_number() OVER (PARTITION BY event_type ORDER BY {TS}, event_id) AS place FROM sp")
    q["f16_describe_schema"] = with_ctes(
        ["r8"], "SELECT c.column_name, c.column_type, (SELECT count(*) FROM r8) AS n_rows FROM (VALUES ('event_type', 'string'), "
        "('datetime_gmt', 'timestamp_ntz'), ('event_id', 'bigint'), ('generation_mw', 'double'), ('pred_generation_mw', 'double')) c(column_name, column_type)")
    q["k14_split_coverage"] = with_ctes(
        SCORED + [split_cte("scored")],
        "SELECT event_type, split, count(*) AS n_rows, count(*) AS n_predicted, round(avg(generation_mw), 3) AS mean_actual, "
        "round(CASE WHEN split = 'train' THEN avg(generation_mw) END, 3) AS mean_predicted_train FROM sp GROUP BY 1, 2")
    models = ("('given', pred_generation_mw), ('shifted', pred_generation_mw + 1.5::DOUBLE), "
              "('by_hour', CASE WHEN event_id % 5 <> 0 THEN hour(datetime_gmt) * 2.0::DOUBLE END)")
    q["j10_metrics_of_models"] = with_ctes(
        SCORED + [split_cte("scored"), f"m AS (SELECT sp.split, sp.generation_mw AS a, t.model, t.p FROM sp, LATERAL (VALUES {models}) t(model, p))"],
        "SELECT model, split, count(*) AS n, round(1.0 - sum((p - a) ^ 2) / (var_pop(a) * count(*)), 3) AS r2, "
        "round(avg(abs(p - a)), 3) AS mae, round(avg((p - a) ^ 2), 3) AS mse, round(sqrt(avg((p - a) ^ 2)), 3) AS rmse "
        "FROM m WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2")
    text = "strftime(datetime_gmt, '%Y-%m-%d %H:%M:%S')"
    q["b7_unparsed"] = with_ctes(
        SCORED + [f"""x AS (SELECT event_type, 'end' AS column_name, {text} AS t FROM scored UNION ALL
          SELECT event_type, 'start', CASE WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN '31 May'
          WHEN event_id % 19 <> 0 THEN {text} END FROM scored)"""],
        "SELECT event_type, column_name, count(*) AS n_text, count(*) FILTER (TRY_CAST(t AS TIMESTAMP) IS NULL) AS n_unparsed, "
        "min(t) FILTER (TRY_CAST(t AS TIMESTAMP) IS NULL) AS example FROM x WHERE t IS NOT NULL GROUP BY 1, 2")
    return q


def _root_splits_sql(bins: int = 256, l1: float = 1.0, l2: float = 1.0, rate: float = 0.05) -> str:
    """The best first split per key, from the histogram of first gradients over the bins of each feature."""
    unit = 1 << 20
    features = {"irradiance": "CASE WHEN event_id % 7 <> 0 THEN global_tilted_irradiance_instant END", "hour": f"CAST(hour({TS}) AS DOUBLE)",
                "day": f"CAST(day({TS}) AS DOUBLE)", "capacity_mwp": "capacity_mwp"}
    long = " UNION ALL ".join(f"SELECT event_type, {i} AS f, '{n}' AS feature, {e} AS v, y FROM y" for i, (n, e) in enumerate(features.items()))
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {l1 * unit!r}::DOUBLE, 0.0::DOUBLE))"
    worth = lambda s: f"({soft('g' + s)} ^ 2 / (c{s} + {l2}::DOUBLE))"
    leaf = lambda s: f"floor(-{soft('g' + s)} / (c{s} + {l2}::DOUBLE) * {rate}::DOUBLE + 0.5::DOUBLE) / {unit}::DOUBLE"
    return with_ctes(
        SCORED + [
            f"y AS (SELECT *, CAST(floor(generation_mw * {unit}::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS y FROM scored WHERE generation_mw IS NOT NULL)",
            "b AS (SELECT event_type, CAST(floor(sum(y) / count(*) + 0.5::DOUBLE) AS BIGINT) AS base FROM y GROUP BY 1)",
            f"l AS (SELECT l.event_type, f, feature, v, base - y AS g FROM ({long}) l JOIN b USING (event_type))",
            "k AS (SELECT event_type, f, v, count(*) AS c FROM l WHERE v IS NOT NULL GROUP BY 1, 2, 3)",
            """r AS (SELECT *, count(*) OVER (PARTITION BY event_type, f) AS kinds, sum(c) OVER (PARTITION BY event_type, f) AS n,
              sum(c) OVER (PARTITION BY event_type, f ORDER BY v) AS upto FROM k)""",
            f"e AS (SELECT event_type, f, v AS e FROM r WHERE kinds <= {bins} OR floor(upto * {bins} / n) > floor((upto - c) * {bins} / n))",
            "m AS (SELECT l.event_type, l.f, l.feature, e.e AS v, l.g FROM l ASOF LEFT JOIN e ON l.event_type = e.event_type AND l.f = e.f AND l.v <= e.e)",
            "h AS (SELECT event_type, f, feature, v, CAST(sum(g) AS DOUBLE) AS g, count(*) AS c FROM m GROUP BY 1, 2, 3, 4)",
            """w AS (SELECT event_type, f, feature, v,
              sum(CASE WHEN v IS NOT NULL THEN g ELSE 0 END) OVER u AS gu, sum(CASE WHEN v IS NOT NULL THEN c ELSE 0 END) OVER u AS cu,
              sum(CASE WHEN v IS NULL THEN g ELSE 0 END) OVER p AS gm, sum(CASE WHEN v IS NULL THEN c ELSE 0 END) OVER p AS cm,
              sum(g) OVER p AS gt, CAST(sum(c) OVER p AS BIGINT) AS ct
              FROM h WINDOW p AS (PARTITION BY event_type, f), u AS (PARTITION BY event_type, f ORDER BY v NULLS FIRST ROWS UNBOUNDED PRECEDING))""",
            """s AS (SELECT w.*, m.missing_left, gu + CASE WHEN m.missing_left THEN gm ELSE 0 END AS gl,
              CAST(cu + CASE WHEN m.missing_left THEN cm ELSE 0 END AS BIGINT) AS cl
              FROM w, (VALUES (false), (true)) m(missing_left) WHERE v IS NOT NULL AND (cm > 0 OR NOT m.missing_left))""",
            "z AS (SELECT *, gt - gl AS gr, ct - cl AS cr FROM s)",
            f"""q AS (SELECT *, ({worth('l')} + {worth('r')} - {worth('t')}) * 0.5::DOUBLE / {float(unit) ** 2!r}::DOUBLE AS gain FROM z WHERE cl >= 1 AND cr >= 1
              QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY gain DESC, f, v, missing_left) = 1)""",
        ],
        f"""SELECT event_type, feature, round(v, 6) AS threshold, missing_left, round(gain, 6) AS gain, cl AS n_left, cr AS n_right,
          round({leaf('l')}, 6) AS left_value, round({leaf('r')}, 6) AS right_value FROM q WHERE gain > 0.000001""")
