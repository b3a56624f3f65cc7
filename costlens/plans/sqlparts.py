"""DuckDB SQL fragments for the oracle twins (``oracle_sql``).

Each fragment computes what one library function does, with sums over the raw
cost in decimals or integers, so both engines produce bit-identical doubles.
Fragments are CTE bodies; ``with_(...)`` strings them together.
"""

from __future__ import annotations

S = "cloud_provider, unified_category"


def with_(*ctes: tuple[str, str], final: str) -> str:
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{final}"


def cents(x: str) -> str:
    return f"CAST(ROUND({x} * 100) AS BIGINT)"


def exact(x: str) -> str:
    return f"CAST({x} AS DECIMAL(28,10))"


def sum_money(x: str) -> str:
    """The exact sum of a raw cost as a double (by its text: one rounding)."""
    return f"CAST(CAST(SUM({exact(x)}) AS VARCHAR) AS DOUBLE)"


def sum_cents(x: str) -> str:
    return f"CAST(ROUND(SUM({exact(x)}), 2) * 100 AS BIGINT)"


def d2d(x: str) -> str:
    """Twin of ``dec_to_double``: exact 32-bit halves, one rounding."""
    h = f"CAST({x} AS HUGEINT)"
    return (f"(CAST(({h} - {h} % 4294967296) // 4294967296 AS DOUBLE) * CAST(4294967296 AS DOUBLE)"
            f" + CAST({h} % 4294967296 AS DOUBLE))")


CATEGORY_FROM_TYPE = ("CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'COMPUTE' "
                      "WHEN p_type IN ('MEDIUM', 'SMALL') THEN 'STORAGE' "
                      "WHEN p_type = 'LARGE' THEN 'NETWORK' ELSE 'OTHER' END")
PROVIDER = "CASE l_returnflag WHEN 'A' THEN 'AWS' WHEN 'N' THEN 'GCP' WHEN 'R' THEN 'Azure' END"
ENV = "CASE l_linestatus WHEN 'F' THEN 'prod' WHEN 'O' THEN 'dev' ELSE 'unknown' END"


def spend(team: bool = True, tenant: bool = False) -> str:
    joins = "FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"
    if team:
        joins += (" LEFT JOIN orders ON l_orderkey = o_orderkey"
                  " LEFT JOIN customer ON o_custkey = c_custkey")
    if tenant:
        joins += (" LEFT JOIN supplier ON l_suppkey = s_suppkey"
                  " LEFT JOIN nation ON s_nationkey = n_nationkey")
    org = ("'org-' || COALESCE(CAST(n_regionkey AS VARCHAR), 'unknown') AS organization_id,\n"
           if tenant else "")
    team_sql = "COALESCE(LOWER(c_mktsegment), 'unknown')" if team else "'unknown'"
    return f"""SELECT {org}l_shipdate AS "timestamp", {PROVIDER} AS cloud_provider,
  {CATEGORY_FROM_TYPE} AS unified_category, l_extendedprice AS cost, {ENV} AS normalized_env,
  {team_sql} AS normalized_team, CAST(l_quantity >= 49 AS INTEGER) AS is_anomaly,
  CASE WHEN l_quantity >= 49 THEN 'spike' ELSE 'none' END AS anomaly_type
{joins}"""


def daily(src: str = "spend", keys: str = S) -> str:
    return f"""SELECT {keys}, CAST("timestamp" AS DATE) AS date,
  {sum_cents('cost')} AS cost_cents, COUNT(*) AS n_rows,
  {sum_money('cost')} AS cost
FROM {src} GROUP BY ALL"""


def daily_flag(src: str = "spend", keys: str = S) -> str:
    return f"""SELECT {keys}, CAST("timestamp" AS DATE) AS date,
  {sum_cents('cost')} AS cost_cents,
  CAST(MAX(is_anomaly) AS INTEGER) AS had_anomaly,
  {sum_money('cost')} AS cost
FROM {src} GROUP BY ALL"""


def seasonal(src: str = "daily", keys: str = S) -> str:
    w7 = f"(PARTITION BY {keys} ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    return f"""SELECT *, cost_cents - trend_cents - seasonal_cents AS resid_cents FROM (
  SELECT * EXCLUDE (_dow),
    CAST(ROUND(CAST(SUM(cost_cents - trend_cents) OVER (PARTITION BY {keys}, _dow) AS DOUBLE)
               / COUNT(*) OVER (PARTITION BY {keys}, _dow)) AS BIGINT)
    - CAST(ROUND(CAST(SUM(cost_cents - trend_cents) OVER (PARTITION BY {keys}) AS DOUBLE)
               / COUNT(*) OVER (PARTITION BY {keys})) AS BIGINT) AS seasonal_cents
  FROM (
    SELECT *, CAST(ROUND(CAST(SUM(cost_cents) OVER {w7} AS DOUBLE) / COUNT(cost_cents) OVER {w7})
                   AS BIGINT) AS trend_cents,
           isodow(date) - 1 AS _dow
    FROM {src}))"""


def rolling_z(src: str, x: str, out: str, keys: str = S, window: int = 14) -> str:
    w = f"(PARTITION BY {keys} ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    var = "(CAST(_n AS DECIMAL(38,0)) * _q - CAST(_s AS DECIMAL(38,0)) * CAST(_s AS DECIMAL(38,0)))"
    gap = f"CAST(_n * {x} - _s AS DECIMAL(38,0))"
    return f"""SELECT * EXCLUDE (_n, _s, _q),
  CASE WHEN _n < 2 OR {var} = 0 THEN 0 ELSE CAST({gap} * {gap} * CAST(_n - 1 AS DECIMAL(38,0)) > 9 * CAST(_n AS DECIMAL(38,0)) * {var} AS INTEGER) END AS {out}_over,
  ROUND(CASE WHEN _n < 2 OR (CAST(_n AS DECIMAL(38,0)) * _q - CAST(_s AS DECIMAL(38,0)) * CAST(_s AS DECIMAL(38,0))) = 0
             THEN 0.0
             ELSE CAST(_n * {x} - _s AS DOUBLE)
                  / SQRT({d2d("CAST(_n AS DECIMAL(38,0)) * _q - CAST(_s AS DECIMAL(38,0)) * CAST(_s AS DECIMAL(38,0))")}
                         * _n / (_n - 1)) END, 6) AS {out}
FROM (SELECT *, COUNT({x}) OVER {w} AS _n, CAST(SUM({x}) OVER {w} AS BIGINT) AS _s,
             SUM(CAST({x} AS DECIMAL(38,0)) * CAST({x} AS DECIMAL(38,0))) OVER {w} AS _q
      FROM {src})"""


def day_scores(src: str = "resid", keys: str = S) -> str:
    return f"""SELECT * EXCLUDE (_z, _z_over, _nd),
  CASE WHEN _nd < 14 THEN 0.0 ELSE _z END AS stat_z_score,
  CASE WHEN _nd < 14 THEN 0 ELSE _z_over END AS stat_is_anomaly
FROM (SELECT *, COUNT(*) OVER (PARTITION BY {keys}) AS _nd FROM ({rolling_z(src, 'resid_cents', '_z', keys)}))"""


def scored_days(spend_sql: str | None = None) -> list[tuple[str, str]]:
    return [("spend", spend_sql or spend(team=False)), ("daily", daily()),
            ("resid", seasonal()), ("scores", day_scores())]


def stat_rows(src: str = "spend", scores: str = "scores", keys: str = S) -> str:
    on = " AND ".join(f"r.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    return f"""SELECT r.*, COALESCE(d.stat_z_score, 0.0) AS stat_z_score,
  COALESCE(d.stat_is_anomaly, 0) AS stat_is_anomaly
FROM {src} r LEFT JOIN {scores} d ON {on} AND CAST(r."timestamp" AS DATE) = d.date"""


# --- stand-in raw exports and their normalisation ---------------------------
NA_LIST = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
           "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")

_LINE_TEAM = ("FROM lineitem LEFT JOIN part ON l_partkey = p_partkey "
              "LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
_RAW_ENV = "CASE l_linestatus WHEN 'F' THEN 'Prod' WHEN 'O' THEN 'Dev' END"
_LABEL = ("CAST(l_quantity >= 49 AS INTEGER) AS is_anomaly, "
          "CASE WHEN l_quantity >= 49 THEN 'spike' ELSE 'none' END AS anomaly_type")


def _vendor(compute: str, storage: str, network: str) -> str:
    return (f"CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN '{compute}' "
            f"WHEN p_type IN ('MEDIUM', 'SMALL') THEN '{storage}' "
            f"WHEN p_type = 'LARGE' THEN '{network}' ELSE 'Promo ' || p_type END")


RAW_AWS = f"""SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "lineItem/UsageStartDate",
  {_vendor('AmazonEC2', 'AmazonStorage', 'AmazonNetwork')} AS "productCode",
  l_extendedprice AS "lineItem/UnblendedCost", l_extendedprice * (1 - l_discount) AS "lineItem/NetUnblendedCost",
  {_RAW_ENV} AS "resourceTags/user:Environment", c_mktsegment AS "resourceTags/user:Team", {_LABEL}
{_LINE_TEAM} WHERE l_returnflag = 'A'"""

RAW_GCP = f"""SELECT strftime(l_shipdate, '%Y-%m-%d') AS usage_start_time,
  {_vendor('Compute Engine', 'Cloud Storage', 'Cloud Network')} AS "service/description",
  l_extendedprice AS cost, {_RAW_ENV} AS "labels/env", c_mktsegment AS "labels/owner", {_LABEL}
{_LINE_TEAM} WHERE l_returnflag = 'N'"""

RAW_AZURE = f"""SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "UsageDateTime",
  {_vendor('Virtual Machines', 'Storage', 'Network')} AS "MeterCategory",
  l_extendedprice AS "CostInBillingCurrency",
  CAST(json_object('env', {_RAW_ENV}, 'team', c_mktsegment) AS VARCHAR) AS "Tags", {_LABEL}
{_LINE_TEAM} WHERE l_returnflag = 'R'"""

RAW_AZURE_EVENTS = """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "UsageDateTime",
  event_type AS "MeterCategory", value AS "CostInBillingCurrency", props AS "Tags",
  0 AS is_anomaly, 'none' AS anomaly_type FROM events"""


def na_null(x: str) -> str:
    return f"CASE WHEN {x} IN ({NA_LIST}) THEN NULL ELSE {x} END"


def lower_fill(x: str) -> str:
    return f"COALESCE(LOWER({na_null(x)}), 'unknown')"


def parse_ts(x: str) -> str:
    return f"CAST({na_null(x)} AS TIMESTAMP)"


def category_map(x: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE 'OTHER' END"


def json_tag(x: str, key: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR NOT json_valid({x}) THEN 'unknown' "
            f"WHEN json_type({x}) <> 'OBJECT' THEN 'unknown' "
            f"WHEN NOT list_contains(json_keys({x}), '{key}') THEN 'unknown' "
            f"WHEN json_type({x}, '$.{key}') = 'NULL' THEN 'none' "
            f"ELSE LOWER(json_extract_string({x}, '$.{key}')) END")


def norm_aws(src: str = "raw_aws") -> str:
    from costlens import fixed
    return f"""SELECT {parse_ts('"lineItem/UsageStartDate"')} AS "timestamp", 'AWS' AS cloud_provider,
  {category_map('"productCode"', fixed.AWS_SERVICE_MAP)} AS unified_category,
  CAST("lineItem/UnblendedCost" AS DOUBLE) AS cost,
  {lower_fill('"resourceTags/user:Environment"')} AS normalized_env,
  {lower_fill('"resourceTags/user:Team"')} AS normalized_team,
  CAST(is_anomaly AS INTEGER) AS is_anomaly, anomaly_type FROM {src}"""


def norm_gcp(src: str = "raw_gcp") -> str:
    from costlens import fixed
    return f"""SELECT {parse_ts('usage_start_time')} AS "timestamp", 'GCP' AS cloud_provider,
  {category_map('"service/description"', fixed.GCP_SERVICE_MAP)} AS unified_category,
  CAST(cost AS DOUBLE) AS cost, {lower_fill('"labels/env"')} AS normalized_env,
  {lower_fill('"labels/owner"')} AS normalized_team,
  CAST(is_anomaly AS INTEGER) AS is_anomaly, anomaly_type FROM {src}"""


def norm_azure(src: str = "raw_azure") -> str:
    from costlens import fixed
    return f"""SELECT {parse_ts('"UsageDateTime"')} AS "timestamp", 'Azure' AS cloud_provider,
  {category_map('"MeterCategory"', fixed.AZURE_SERVICE_MAP)} AS unified_category,
  CAST("CostInBillingCurrency" AS DOUBLE) AS cost, {json_tag('"Tags"', 'env')} AS normalized_env,
  {json_tag('"Tags"', 'team')} AS normalized_team,
  CAST(is_anomaly AS INTEGER) AS is_anomaly, anomaly_type FROM {src}"""


UNION_CLOUDS = [("raw_aws", RAW_AWS), ("raw_gcp", RAW_GCP), ("raw_azure", RAW_AZURE),
                ("spend", f"{norm_aws()}\nUNION ALL\n{norm_gcp()}\nUNION ALL\n{norm_azure()}")]


# --- row-level tier-2 features -----------------------------------------------
SPEND_ORDER = '"timestamp", cost, normalized_env, normalized_team, is_anomaly, anomaly_type'


def row_features(src: str = "spend", keys: str = S, order: str = SPEND_ORDER) -> str:
    w = f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    mean = "CASE WHEN _n > 0 THEN CAST(_s AS DOUBLE) / (_n * 100000000) END"
    var = d2d("CAST(_n AS DECIMAL(38,0)) * _q - CAST(_s AS DECIMAL(38,0)) * CAST(_s AS DECIMAL(38,0))")
    return f"""SELECT * EXCLUDE (_n, _s, _q, _c),
  CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
  CAST(isodow("timestamp") - 1 IN (5, 6) AS INTEGER) AS is_weekend,
  COALESCE({mean}, 0.0) AS rolling_mean_7d,
  COALESCE(CASE WHEN _n >= 2 THEN SQRT({var} / (_n * (_n - 1) * 10000000000000000)) END, 0.0) AS rolling_std_7d,
  COALESCE(cost / ({mean} + 1e-05), 0.0) AS cost_ratio
FROM (SELECT *, COUNT(_c) OVER {w} AS _n, CAST(SUM(_c) OVER {w} AS BIGINT) AS _s,
             SUM(CAST(_c AS DECIMAL(38,0)) * CAST(_c AS DECIMAL(38,0))) OVER {w} AS _q
      FROM (SELECT *, CAST(ROUND(cost * 100000000) AS BIGINT) AS _c FROM {src}))"""


def minmax_scaled(src: str = "feat", keys: str = S,
                  feats: tuple[str, ...] = ("cost", "cost_ratio", "rolling_mean_7d")) -> str:
    aggs = ", ".join(f"MIN({f}) AS {f}_min, MAX({f}) AS {f}_max" for f in feats)
    on = " AND ".join(f"r.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    scaled = ", ".join(
        f"CASE WHEN m.{f}_max = m.{f}_min THEN 0.0 ELSE (r.{f} - m.{f}_min) / (m.{f}_max - m.{f}_min) END"
        f" AS {f}_scaled" for f in feats)
    return f"""SELECT r.*, {scaled} FROM {src} r
JOIN (SELECT {keys}, {aggs} FROM {src} GROUP BY ALL) m ON {on}"""


def sequences(src: str, feats: tuple[str, ...], keys: str = S, order: str = SPEND_ORDER,
              seq_len: int = 14, out: str = "window") -> str:
    w = f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {seq_len} PRECEDING AND 1 PRECEDING)"
    vec = ", ".join(f"CAST({f} AS DOUBLE)" for f in feats)
    return f"""SELECT * EXCLUDE (_seq), CASE WHEN len(_seq) = {seq_len} THEN flatten(_seq) END AS {out}
FROM (SELECT *, list([{vec}]) OVER {w} AS _seq FROM {src})"""


# --- daily cleaned series and window-only forecasting ------------------------
D38 = "DECIMAL(38,0)"


def dec(x: str) -> str:
    return f"CAST({x} AS {D38})"


def cleaned(src: str = "d", keys: str = S) -> str:
    w = f"(PARTITION BY {keys} ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    cc = "CASE WHEN had_anomaly = 1 THEN rolling_median ELSE cost END"
    return f"""SELECT *, {cc} AS cleaned_cost, CAST(ROUND({cc} * 100) AS BIGINT) AS y
FROM (SELECT *, quantile_cont(cost_cents, 0.5) OVER {w} / 100 AS rolling_median FROM {src})"""


def series_ctes(spend_sql: str | None = None, keys: str = S) -> list[tuple[str, str]]:
    return [("spend", spend_sql or spend(team=False)), ("d", daily_flag(keys=keys)),
            ("series", cleaned(keys=keys))]


EPOCH = "CAST(date - DATE '1970-01-01' AS BIGINT)"


def using(keys: str) -> str:
    return f"USING ({keys})"


def tw_fit(src: str, p: str, keys: str = S) -> list[tuple[str, str]]:
    """trend_weekday_fit: CTEs {p}fit (slope, intercept, dates), {p}wd, {p}sig."""
    den = f"{dec('n')} * sxx - {dec('sx')} * {dec('sx')}"
    fit = f"""SELECT {keys}, n, first_date, last_date,
  CASE WHEN ({den}) = 0 THEN 0.0
       ELSE {d2d(f"{dec('n')} * sxy - {dec('sx')} * {dec('sy')}")} / {d2d(den)} END AS slope,
  CASE WHEN ({den}) = 0 THEN CAST(sy AS DOUBLE) / n
       ELSE {d2d(f"{dec('sy')} * sxx - {dec('sx')} * sxy")} / {d2d(den)} END AS intercept
FROM (SELECT {keys}, COUNT(*) AS n, CAST(SUM(_x) AS BIGINT) AS sx, CAST(SUM(y) AS BIGINT) AS sy,
        SUM({dec('_x')} * {dec('_x')}) AS sxx, SUM({dec('_x')} * {dec('y')}) AS sxy,
        MIN(date) AS first_date, MAX(date) AS last_date
      FROM (SELECT *, {EPOCH} AS _x FROM {src}) GROUP BY ALL)"""
    resid = f"""SELECT t.*, t.y - CAST(ROUND(f.intercept + f.slope * {EPOCH.replace('date', 't.date')}) AS BIGINT) AS _r,
  isodow(t.date) - 1 AS _dow FROM {src} t JOIN {p}fit f {using(keys)}"""
    wd = f"""SELECT {keys}, _dow, CAST(ROUND(CAST(SUM(_r) AS DOUBLE) / COUNT(*)) AS BIGINT) AS _eff
FROM {p}resid GROUP BY ALL"""
    sig = f"""SELECT {keys},
  SQRT({d2d(f"{dec('_n')} * _q - {dec('_s')} * {dec('_s')}")} / CAST(_n * _n AS DOUBLE)) AS sigma_cents
FROM (SELECT {keys}, COUNT(*) AS _n, CAST(SUM(_r - _eff) AS BIGINT) AS _s,
        SUM({dec('_r - _eff')} * {dec('_r - _eff')}) AS _q
      FROM {p}resid JOIN {p}wd {using(keys + ', _dow')} GROUP BY ALL)"""
    return [(f"{p}fit", fit), (f"{p}resid", resid), (f"{p}wd", wd), (f"{p}sig", sig)]


def tw_pred(dates: str, p: str, keys: str = S, extra: str = "") -> str:
    """Dates (keys, date, ...) joined to the fit: adds pred_cents, sigma_cents."""
    return f"""SELECT q.*, CAST(ROUND(f.intercept + f.slope * {EPOCH.replace('date', 'q.date')}) AS BIGINT)
    + COALESCE(w._eff, 0) AS pred_cents, g.sigma_cents{extra}
FROM {dates} q JOIN {p}fit f {using(keys)} JOIN {p}sig g {using(keys)}
LEFT JOIN {p}wd w ON {' AND '.join(f'w.{k.strip()} = q.{k.strip()}' for k in keys.split(','))}
     AND w._dow = isodow(q.date) - 1"""


def future(p: str, horizon: int, keys: str = S) -> str:
    return f"""SELECT {keys}, h, CAST(last_date + h AS DATE) AS date
FROM {p}fit, (SELECT CAST(unnest(generate_series(1, {horizon})) AS INTEGER) AS h)"""


def band(model: str) -> str:
    return f"""GREATEST(0.0, CAST(pred_cents AS DOUBLE) / 100) AS predicted_cost,
  GREATEST(0.0, (pred_cents - 1.645 * sigma_cents) / 100) AS lower_bound,
  GREATEST(0.0, (pred_cents + 1.645 * sigma_cents) / 100) AS upper_bound, '{model}' AS model_used"""


def naive_fit(src: str, p: str, keys: str = S) -> list[tuple[str, str]]:
    nb = f"""SELECT {keys}, date, y AS _y, y - LAG(y, 7) OVER (PARTITION BY {keys} ORDER BY date) AS _r,
  ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY date DESC) - 1 AS _back FROM {src}"""
    fit = f"""SELECT {keys}, last_date,
  CASE WHEN _n > 0 THEN SQRT({d2d(f"{dec('_n')} * _q - {dec('_s')} * {dec('_s')}")}
                             / CAST(_n * _n AS DOUBLE)) END AS sigma_cents
FROM (SELECT {keys}, MAX(date) AS last_date, COUNT(_r) AS _n, CAST(SUM(_r) AS BIGINT) AS _s,
        SUM({dec('_r')} * {dec('_r')}) AS _q FROM {p}nb GROUP BY ALL)"""
    slot = f"SELECT {keys}, 6 - _back AS slot, _y FROM {p}nb WHERE _back < 7"
    return [(f"{p}nb", nb), (f"{p}fit", fit), (f"{p}slot", slot)]


def naive_pred(steps: str, p: str, keys: str = S) -> str:
    on = ' AND '.join(f's.{k.strip()} = q.{k.strip()}' for k in keys.split(','))
    return f"""SELECT q.*, s._y AS pred_cents, f.sigma_cents
FROM {steps} q JOIN {p}fit f {using(keys)}
LEFT JOIN {p}slot s ON {on} AND s.slot = ((q.h - 1) % 7)"""


def tw_forecast(src: str, p: str, horizon: int = 90, keys: str = S) -> list[tuple[str, str]]:
    return tw_fit(src, p, keys) + [
        (f"{p}fut", future(p, horizon, keys)),
        (f"{p}fc", f"SELECT {keys}, date, {band('trend_weekday')} FROM ({tw_pred(p + 'fut', p, keys)})")]


def naive_forecast(src: str, p: str, horizon: int = 90, keys: str = S) -> list[tuple[str, str]]:
    return naive_fit(src, p, keys) + [
        (f"{p}fut", future(p, horizon, keys)),
        (f"{p}fc", f"SELECT {keys}, date, {band('seasonal_naive')} FROM ({naive_pred(p + 'fut', p, keys)})")]


def route(src: str = "series", keys: str = S, n_val: int = 30) -> list[tuple[str, str]]:
    sp = f"""SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS INTEGER) AS pos,
  CAST(ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY date DESC) <= {n_val} AS INTEGER) AS is_validation
FROM {src}"""
    val = f"""SELECT v.*, v.pos - t._nt + 1 AS h FROM rt_sp v
JOIN (SELECT {keys}, COUNT(*) AS _nt FROM rt_train GROUP BY ALL) t {using(keys)} WHERE v.is_validation = 1"""
    both = f"""SELECT a.{keys.replace(', ', ', a.')}, a.date, a.y, a.pred_cents AS trend_cents, b.pred_cents AS naive_cents
FROM ({tw_pred('rt_val', 'rtt', keys)}) a JOIN ({naive_pred('rt_val', 'rtn', keys)}) b
ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND a.date = b.date"""
    wm = ("CASE WHEN actual_abs = 0 THEN 0.0 ELSE CAST({e} AS DOUBLE) / actual_abs END")
    res = f"""SELECT {keys}, {wm.format(e='trend_err')} AS wmape_trend, {wm.format(e='naive_err')} AS wmape_naive,
  CASE WHEN {wm.format(e='trend_err')} < {wm.format(e='naive_err')} THEN 'trend_weekday' ELSE 'seasonal_naive' END
    AS model_used
FROM (SELECT {keys}, CAST(SUM(ABS(y - trend_cents)) AS BIGINT) AS trend_err,
        CAST(SUM(ABS(y - naive_cents)) AS BIGINT) AS naive_err, CAST(SUM(ABS(y)) AS BIGINT) AS actual_abs
      FROM rt_both GROUP BY ALL)"""
    return ([("rt_sp", sp), ("rt_train", "SELECT * FROM rt_sp WHERE is_validation = 0"), ("rt_val", val)]
            + tw_fit("rt_train", "rtt", keys) + naive_fit("rt_train", "rtn", keys)
            + [("rt_both", both), ("route", res)])


def production(src: str = "series", keys: str = S, horizon: int = 90) -> list[tuple[str, str]]:
    on = ' AND '.join(f'r.{k.strip()} = c.{k.strip()}' for k in keys.split(','))
    final = f"""SELECT c.* FROM (SELECT * FROM pt_fc UNION ALL SELECT * FROM pn_fc) c
JOIN route r ON {on} AND c.model_used = r.model_used"""
    return (route(src, keys) + tw_forecast(src, "pt_", horizon, keys) + naive_forecast(src, "pn_", horizon, keys)
            + [("production", final)])
