"""DuckDB SQL twins of the jobs (the correctness oracle).

Each builder returns plain ANSI-ish SQL over the driver's views (events,
lineitem, ...). The float rules of ``vigil.functions.expr`` are spelled out
as CASE expressions because DuckDB's own x/0 is inf and 0/0 is NaN.
"""

from __future__ import annotations

from ..sources import testdata as td

ROUND = 6


def ratio(a: str, b: str) -> str:
    return (f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL "
            f"WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) "
            f"WHEN ({a}) > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN ({a}) < 0 THEN CAST('-inf' AS DOUBLE) ELSE NULL END)")


def ratio0(a: str, b: str) -> str:
    return f"coalesce({ratio(a, b)}, 0.0)"


def nan_null(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def date_id(x: str) -> str:
    return f"CAST(year({x}) * 10000 + month({x}) * 100 + day({x}) AS INTEGER)"


def final(inner: str, cols: list[tuple[str, str]]) -> str:
    """Outer projection matching ``catalog.finalize``.

    kinds: 'f' double rounded to 6 places, 'd' date as yyyy-MM-dd text,
    'i' bigint, 'n' int, 's' text, 'b' boolean, 'k' keep.
    """
    out = []
    for name, kind in cols:
        q = f'"{name}"'
        if kind == "f":
            out.append(f"round(CAST({q} AS DOUBLE), {ROUND}) + 0.0 AS {q}")
        elif kind == "d":
            out.append(f"strftime(CAST({q} AS DATE), '%Y-%m-%d') AS {q}")
        elif kind == "i":
            out.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "n":
            out.append(f"CAST({q} AS INTEGER) AS {q}")
        elif kind == "s":
            out.append(f"CAST({q} AS VARCHAR) AS {q}")
        else:
            out.append(q)
    return f"SELECT {', '.join(out)} FROM (\n{inner}\n) AS _q"


# ----------------------------------------------------------- logical tables

def client_expr() -> str:
    return f"'client_' || CAST(user_id % {td.N_CLIENTS} AS VARCHAR)"


AD_FACTS = f"""
  SELECT {client_expr()} AS client, {date_id('ts')} AS d_date_id,
         CASE WHEN event_type = 'purchase' THEN CAST(value AS {td.MONEY})
              ELSE CAST(0 AS {td.MONEY}) END AS adwords_revenue,
         CASE WHEN event_id % {td.ORDERS_NULL_EVERY} = 0 THEN NULL
              ELSE CAST(event_type = 'purchase' AS BIGINT) END AS adwords_orders,
         CASE WHEN event_id % {td.CONVERSIONS_NULL_EVERY} = 0 THEN NULL
              ELSE CAST(event_type = 'purchase' AS BIGINT) END AS adwords_conversions,
         CAST(event_type = 'click' AS BIGINT) AS adwords_clicks,
         CAST(event_type = 'view' AS BIGINT) AS adwords_impressions,
         CASE WHEN event_type = 'click' THEN CAST(value AS {td.MONEY})
              ELSE CAST(0 AS {td.MONEY}) END AS adwords_cost
  FROM events
  WHERE event_type IN ('view', 'click', 'purchase')
    AND CAST(json_extract_string(props, '$.k') AS INTEGER) < {td.CHANNEL_MAX_K}"""

SITE_FACTS = f"""
  SELECT {client_expr()} AS client, {date_id('ts')} AS d_date_id,
         count(*) AS orders, sum(CAST(value AS {td.MONEY})) AS revenue
  FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"""

EVENTS_D_DATE = f"""
  SELECT DISTINCT {date_id('CAST(ts AS DATE)')} AS id, CAST(ts AS DATE) AS full_date FROM events"""

HISTORY_LINES = """
  SELECT l.l_extendedprice, l.l_discount, l.l_tax, l.l_quantity, l.l_shipdate,
         c.c_mktsegment AS client
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey"""

HISTORY_AD_FACTS = f"""
  SELECT client, {date_id('l_shipdate')} AS d_date_id,
         CAST(l_extendedprice AS {td.MONEY}) * (1 - CAST(l_discount AS {td.MONEY}))
           AS adwords_revenue,
         CAST(1 AS BIGINT) AS adwords_orders, CAST(NULL AS BIGINT) AS adwords_conversions,
         CAST(l_quantity AS BIGINT) AS adwords_clicks,
         CAST(l_quantity * 10 AS BIGINT) AS adwords_impressions,
         CAST(l_extendedprice AS {td.MONEY}) * CAST(l_tax AS {td.MONEY}) AS adwords_cost
  FROM hl WHERE l_discount >= {td.PROMOTED_DISCOUNT}"""

HISTORY_SITE_FACTS = f"""
  SELECT client, {date_id('l_shipdate')} AS d_date_id, count(*) AS orders,
         sum(CAST(l_extendedprice AS {td.MONEY}) * (1 - CAST(l_discount AS {td.MONEY})))
           AS revenue
  FROM hl GROUP BY 1, 2"""

HISTORY_D_DATE = f"""
  SELECT DISTINCT {date_id('CAST(l_shipdate AS DATE)')} AS id,
         CAST(l_shipdate AS DATE) AS full_date FROM lineitem"""


def source_ctes(kind: str) -> str:
    if kind == "events":
        return f"ad AS ({AD_FACTS}),\nsite AS ({SITE_FACTS}),\nd_date AS ({EVENTS_D_DATE})"
    return (f"hl AS ({HISTORY_LINES}),\nad AS ({HISTORY_AD_FACTS}),\n"
            f"site AS ({HISTORY_SITE_FACTS}),\nd_date AS ({HISTORY_D_DATE})")


# ----------------------------------------------------------- channel (M1)

BASE = ["orders", "revenue", "clicks", "impressions", "cost"]


def daily_ctes(as_of: str, lookback: int) -> str:
    """CTEs ending in ``daily`` (the M1 frame); needs ad, site, d_date."""
    lo = f"CAST(DATE '{as_of}' - INTERVAL {lookback} DAY AS DATE)"
    hi = f"DATE '{as_of}'"
    w7 = "(PARTITION BY client ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    roll = []
    for c in BASE:
        roll.append(f"CASE WHEN count({c}) OVER {w7} = 7 THEN avg({c}) OVER {w7} END AS {c}_7_avg")
        roll.append(f"CASE WHEN count({c}) OVER {w7} = 7 THEN sum({c}) OVER {w7} END AS sum_{c}")
    return f"""
acct AS (
  SELECT a.client, d.full_date AS Date,
         CAST(sum(adwords_revenue) AS DOUBLE) AS revenue,
         sum(coalesce(adwords_orders, adwords_conversions, 0)) AS orders,
         sum(adwords_clicks) AS clicks, sum(adwords_impressions) AS impressions,
         CAST(sum(adwords_cost) AS DOUBLE) AS cost
  FROM ad a JOIN d_date d ON a.d_date_id = d.id
  WHERE d.full_date >= {lo} AND d.full_date <= {hi}
  GROUP BY 1, 2),
st AS (
  SELECT s.client, d.full_date AS Date, max(orders) AS site_orders,
         CAST(max(revenue) AS DOUBLE) AS site_revenue
  FROM site s JOIN d_date d ON s.d_date_id = d.id
  WHERE d.full_date >= {lo} AND d.full_date <= {hi}
  GROUP BY 1, 2),
jd AS (
  SELECT a.client, a.Date,
         coalesce(a.revenue, 0) AS revenue, coalesce(a.orders, 0) AS orders,
         coalesce(a.clicks, 0) AS clicks, coalesce(a.impressions, 0) AS impressions,
         coalesce(a.cost, 0) AS cost, coalesce(s.site_orders, 0) AS site_orders,
         coalesce(s.site_revenue, 0) AS site_revenue,
         {ratio0('a.orders', 's.site_orders')} AS pct_site_orders,
         {ratio0('a.revenue', 's.site_revenue')} AS pct_site_revenue,
         {ratio0('a.revenue', 'a.orders')} AS aov,
         {ratio0('a.orders', 'a.clicks')} AS cr,
         {ratio0('a.clicks', 'a.impressions')} AS ctr,
         {ratio0('a.cost', 'a.clicks')} AS cpc
  FROM acct a JOIN st s ON a.client = s.client AND a.Date = s.Date),
rolled AS (SELECT *, {', '.join(roll)} FROM jd),
daily0 AS (
  SELECT client, Date, revenue, orders, clicks, impressions, cost, site_orders, site_revenue,
         pct_site_orders, pct_site_revenue, aov, cr, ctr, cpc,
         {', '.join(f'{c}_7_avg' for c in BASE)},
         {ratio('sum_revenue', 'sum_orders')} AS aov_7_avg,
         {ratio('sum_orders', 'sum_clicks')} AS cr_7_avg,
         {ratio('sum_clicks', 'sum_impressions')} AS ctr_7_avg,
         {ratio('sum_cost', 'sum_clicks')} AS cpc_7_avg,
         {ratio('cost', 'revenue')} AS cos_m,
         {ratio('sum_cost', 'sum_revenue')} AS cos_m_7_avg,
         {ratio('revenue', 'cost')} AS roas,
         {ratio('sum_revenue', 'sum_cost')} AS roas_7_avg
  FROM rolled),
daily AS (SELECT * FROM daily0 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in DAILY_DOUBLES + ['client', 'Date'])})"""


DAILY_INTS = ["revenue", "orders", "clicks", "impressions", "cost", "site_orders", "site_revenue"]
DAILY_DOUBLES = (["revenue", "orders", "clicks", "impressions", "cost", "site_orders",
                  "site_revenue", "pct_site_orders", "pct_site_revenue", "aov", "cr", "ctr", "cpc"]
                 + [f"{c}_7_avg" for c in BASE]
                 + ["aov_7_avg", "cr_7_avg", "ctr_7_avg", "cpc_7_avg", "cos_m", "cos_m_7_avg",
                    "roas", "roas_7_avg"])


def daily_sql(kind: str, as_of: str, lookback: int, cols: list[tuple[str, str]]) -> str:
    inner = f"WITH {source_ctes(kind)},{daily_ctes(as_of, lookback)}\nSELECT * FROM daily"
    return final(inner, cols)


# ----------------------------------------------------------- health (M5-M7)

def health_ctes(metrics: list[str], n: int = 10, one_dev: float = .6, two_dev: float = .4,
                pixel_days: int = 7, pixel_share: float = .5) -> str:
    """CTEs ending in ``wide`` (client + per metric/check code columns)."""
    from .channel import CODES, py_round
    t1, t2, tz = py_round(one_dev * n), py_round(two_dev * n), py_round(pixel_share * n)
    part = "(PARTITION BY client)"
    ordw = "(PARTITION BY client ORDER BY Date)"
    h1 = []
    for m in metrics:
        h1.append(f"{nan_null(f'avg({m}) OVER {part}')} AS {m}__mean")
        h1.append(f"{nan_null(f'stddev_samp({m}) OVER {part}')} AS {m}__sd")
        h1.append(f"lag({m}) OVER {ordw} AS {m}__prev")
    h2 = []
    for m in metrics:
        h2 += [f"CASE WHEN {m} > {m}__mean THEN 1 ELSE 0 END AS {m}__fa",
               f"CASE WHEN {m} < {m}__mean THEN 1 ELSE 0 END AS {m}__fb",
               f"CASE WHEN {m} < {m}__prev THEN 1 ELSE 0 END AS {m}__fn",
               f"CASE WHEN {m} > {m}__prev THEN 1 ELSE 0 END AS {m}__fp"]
    # islands of equal flags: rows of one island keep their distance to the flag's own row number
    g3, h3 = [], []
    for m in metrics:
        for s in "abnp":
            f = f"{m}__f{s}"
            g3.append(f"rn - row_number() OVER (PARTITION BY client, {f} ORDER BY Date) AS {m}__g{s}")
            h3.append(f"{f} * row_number() OVER (PARTITION BY client, {f}, {m}__g{s} ORDER BY Date) AS {m}__r{s}")
    last_n = f"(cnt - rn) < {n}"
    pix = f"(cnt - rn) < {min(pixel_days, n)}"
    ag = []
    for m in metrics:
        for k in (1, 2, 3):
            ag.append(f"count_if({last_n} AND {m} > {m}__mean + {k} * {m}__sd) AS {m}__gt{k}")
            ag.append(f"count_if({last_n} AND {m} < {m}__mean - {k} * {m}__sd) AS {m}__lt{k}")
        for s in "abnp":
            ag.append(f"max(CASE WHEN {last_n} THEN {m}__r{s} END) AS {m}__mr{s}")
        if m == "revenue":
            ag.append(f"count_if({pix} AND {m} = 0) AS {m}__zero")
    codes = []
    for m in metrics:
        none = f"'{CODES['none']}'"
        track = (f"CASE WHEN {m}__zero > {tz} THEN '{CODES['pixel']}' END" if m == "revenue"
                 else "CAST(NULL AS VARCHAR)")
        codes += [
            f"{track} AS {m}__tracking_alert",
            f"CASE WHEN {m}__gt3 > 0 OR {m}__lt3 > 0 THEN '{CODES['high']}' "
            f"WHEN {m}__gt2 >= {t2} OR {m}__lt2 >= {t2} THEN '{CODES['medium']}' "
            f"WHEN {m}__gt1 >= {t1} OR {m}__lt1 >= {t1} THEN '{CODES['low']}' ELSE {none} END AS {m}__deviation",
            f"CASE WHEN {m}__mrb >= {n - 1} THEN '{CODES['below']}' ELSE {none} END AS {m}__below_mean_trend",
            f"CASE WHEN {m}__mra >= {n - 1} THEN '{CODES['above']}' ELSE {none} END AS {m}__above_mean_trend",
            f"CASE WHEN {m}__mrn >= {n - 1} AND NOT ({m}__mrp >= {n - 1}) THEN '{CODES['negative']}' "
            f"ELSE {none} END AS {m}__negative_slope_trend",
            f"CASE WHEN {m}__mrp >= {n - 1} AND NOT ({m}__mrn >= {n - 1}) THEN '{CODES['positive']}' "
            f"ELSE {none} END AS {m}__positive_slope_trend",
            f"({m}__mrn >= {n - 1} AND {m}__mrp >= {n - 1}) AS {m}__slope_volatile",
        ]
    return f"""
h0 AS (SELECT client, Date, {', '.join(metrics)},
              row_number() OVER {ordw} AS rn, count(*) OVER {part} AS cnt FROM daily),
h1 AS (SELECT *, {', '.join(h1)} FROM h0),
h2 AS (SELECT *, {', '.join(h2)} FROM h1),
g3 AS (SELECT *, {', '.join(g3)} FROM h2),
h3 AS (SELECT *, {', '.join(h3)} FROM g3),
stats AS (SELECT client, {', '.join(ag)} FROM h3 GROUP BY client),
wide AS (SELECT client, {', '.join(codes)} FROM stats)"""


CHECKS = ["tracking_alert", "deviation", "below_mean_trend", "above_mean_trend",
          "negative_slope_trend", "positive_slope_trend"]


def health_matrix_sql(kind: str, as_of: str, lookback: int, metrics: list[str]) -> str:
    least = ", ".join(
        f"least({', '.join(f'{m}__{c}' for c in CHECKS)}) AS {m}" for m in metrics)
    inner = (f"WITH {source_ctes(kind)},{daily_ctes(as_of, lookback)},{health_ctes(metrics)}\n"
             f"SELECT client, {least} FROM wide")
    return final(inner, [("client", "s")] + [(m, "s") for m in metrics])


def health_checks_sql(kind: str, as_of: str, lookback: int, metrics: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT client, '{m}' AS metric, '{c}' AS \"check\", {m}__{c} AS code FROM wide"
        for m in metrics for c in CHECKS)
    inner = (f"WITH {source_ctes(kind)},{daily_ctes(as_of, lookback)},{health_ctes(metrics)}\n"
             f"SELECT * FROM ({rows}) AS u WHERE code IS NOT NULL")
    return final(inner, [("client", "s"), ("metric", "s"), ("check", "s"), ("code", "s")])


RULE_DAYS = f"""rule0 AS (SELECT DISTINCT CAST(o_custkey % {td.N_RULES} AS INTEGER) AS g, CAST(o_orderdate AS DATE) AS Date
          FROM orders),
rule1 AS (SELECT g, Date, row_number() OVER (PARTITION BY g ORDER BY Date DESC) - 1 AS age,
                 date_diff('day', DATE '1992-01-01', Date) % 3 + 100 AS base FROM rule0),
daily AS (SELECT 'rule_' || CAST(g AS VARCHAR) AS client, Date, CAST({td.RULE_VALUE} AS DOUBLE) AS revenue FROM rule1)"""


def alert_rules_sql() -> str:
    cols = CHECKS + ["slope_volatile"]
    inner = (f"WITH {RULE_DAYS},{health_ctes(['revenue'])}\nSELECT client, "
             + ", ".join(f"revenue__{c} AS {c}" for c in cols) + " FROM wide")
    return final(inner, [("client", "s")] + [(c, "s") for c in CHECKS] + [("slope_volatile", "b")])


# ----------------------------------------------------------- models

def _pick(values, idx: str) -> str:
    lits = ", ".join(f"'{v}'" for v in values)
    return f"[{lits}][{idx}]"


MODEL_EVAL = f"""
  SELECT concat_ws('_', lower(n.n_name), {_pick(td.MODEL_TYPES, 's.s_suppkey % 3 + 1')},
                   {_pick(td.PLATFORMS, 's.s_suppkey % 2 + 1')}) AS model,
         CAST(s.s_suppkey AS VARCHAR) AS model_id, lower(n.n_name) AS short_name,
         {_pick(td.MODEL_TYPES, 's.s_suppkey % 3 + 1')} AS type,
         {_pick(td.PLATFORMS, 's.s_suppkey % 2 + 1')} AS ud,
         CASE WHEN s.s_suppkey % 13 <> 0 THEN abs(s.s_acctbal) / 1000 END AS rmse,
         '{{''price'': ' || CAST((s.s_suppkey * 37) % 100 AS VARCHAR)
           || CASE WHEN s.s_suppkey % 5 = 0 THEN ', u''brand'': ' ELSE ', ''brand'': ' END
           || CAST((s.s_suppkey * 53) % 100 AS VARCHAR)
           || ', ''size'': ' || CASE WHEN s.s_suppkey % 7 = 0 THEN 'None'
                                   ELSE CAST((s.s_suppkey * 71) % 100 AS VARCHAR) END
           || ', ''season'': ' || CASE WHEN s.s_suppkey % 11 = 0 THEN '''x'''
                                     ELSE CAST((s.s_suppkey * 89) % 100 AS VARCHAR) END
           || '}}' AS vi,
         CAST(s.s_suppkey * 100 AS VARCHAR) AS training,
         CAST(s.s_suppkey * 25 AS VARCHAR) AS testing,
         '2024-01-01' AS start, '2024-01-30' AS "end"
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey"""


def vi_pairs(src: str, keys: str) -> str:
    """Rows (keys..., variables, importance) of a dict-literal column ``vi``."""
    return f"""
  SELECT {keys}, k AS variables,
         TRY_CAST(json_extract_string(js, '$."' || k || '"') AS DOUBLE) AS importance
  FROM (SELECT {keys}, js, unnest(json_keys(js)) AS k
        FROM (SELECT {keys},
                     replace(regexp_replace(regexp_replace(vi, '([{{,]\\s*)u([''"])', '\\1\\2', 'g'),
                                            ':\\s*None\\b', ': null', 'g'), '''', '"') AS js
              FROM {src}) AS a) AS b"""


def rank_models_sql() -> str:
    inner = f"WITH me AS ({MODEL_EVAL})\nSELECT *, row_number() OVER (ORDER BY rmse NULLS LAST, model_id) AS rank FROM me"
    return final(inner, [("model_id", "s"), ("short_name", "s"), ("type", "s"), ("rmse", "f"), ("rank", "n")])


def importance_sql() -> str:
    inner = (f"WITH me AS ({MODEL_EVAL}),\n"
             f"best AS (SELECT model, first(vi ORDER BY rmse NULLS LAST, model_id) AS vi FROM me GROUP BY model)\n"
             f"SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC NULLS LAST, variables)"
             f" AS position FROM ({vi_pairs('best', 'model')}) AS v")
    return final(inner, [("model", "s"), ("variables", "s"), ("importance", "f"), ("position", "n")])


def choices_sql() -> str:
    inner = (f"WITH me AS ({MODEL_EVAL})\n"
             "SELECT DISTINCT 'client' AS field, short_name AS value FROM me UNION "
             "SELECT DISTINCT 'type', type FROM me UNION SELECT DISTINCT 'platform', ud FROM me")
    return final(inner, [("field", "s"), ("value", "s")])


def _selected_ctes(sel_a, sel_b) -> str:
    return f"""me AS ({MODEL_EVAL}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY short_name, type, ud
                                                   ORDER BY rmse NULLS LAST, model_id) AS rn FROM me) AS x
         WHERE rn = 1),
sel AS (SELECT * FROM (VALUES ('a', '{sel_a[0]}', '{sel_a[1]}', '{sel_a[2]}'),
                              ('b', '{sel_b[0]}', '{sel_b[1]}', '{sel_b[2]}'))
        AS t(side, s_short, s_type, s_ud)),
s AS (SELECT sel.side, best.* FROM sel LEFT JOIN best
      ON sel.s_short = best.short_name AND sel.s_type = best.type AND sel.s_ud = best.ud)"""


def compare_metrics_sql(sel_a, sel_b) -> str:
    from .models import INVALID
    parts = []
    for f in ["training", "testing", "rmse", "start", "end"]:
        val = f'CAST("{f}" AS VARCHAR)'
        parts.append(f"SELECT side, model, '{f}' AS field, {val} AS value FROM s WHERE model IS NOT NULL")
    parts.append(f"SELECT side, model, CAST(NULL AS VARCHAR), '{INVALID}' FROM s WHERE model IS NULL")
    inner = f"WITH {_selected_ctes(sel_a, sel_b)}\n" + "\nUNION ALL ".join(parts)
    return final(inner, [("side", "s"), ("model", "s"), ("field", "s"), ("value", "s")])


def compare_importance_sql(sel_a, sel_b, lead: str | None = "left") -> str:
    from .models import INVALID
    lead_side = {"left": "a", "right": "b"}.get(lead) if lead else None
    own = ("row_number() OVER (PARTITION BY side ORDER BY importance DESC NULLS LAST, variables)")
    kv = f"""kv0 AS ({vi_pairs('(SELECT * FROM s WHERE model IS NOT NULL)', 'side, model')}
            UNION ALL SELECT side, model, NULL, NULL FROM s WHERE model IS NULL),
kv AS (SELECT *, CASE WHEN model IS NOT NULL THEN {own} END AS own FROM kv0)"""
    if lead_side is None:
        body = "SELECT side, variables, importance, own AS position, model FROM kv"
    else:
        body = f"""SELECT kv.side, kv.variables, kv.importance,
       CASE WHEN kv.side = '{lead_side}' THEN kv.own ELSE ref.own END AS position, kv.model
FROM kv LEFT JOIN (SELECT variables, own FROM kv WHERE side = '{lead_side}') AS ref
  ON kv.variables = ref.variables"""
    inner = (f"WITH {_selected_ctes(sel_a, sel_b)},\n{kv}\n"
             f"SELECT side, CASE WHEN model IS NULL THEN '{INVALID}' ELSE variables END AS variables,"
             f" importance, position FROM ({body}) AS o")
    return final(inner, [("side", "s"), ("variables", "s"), ("importance", "f"), ("position", "n")])


# ----------------------------------------------------------- bids

BIDS = f"""
  SELECT {_pick(td.BID_CLIENTS, 'l_partkey % 5 + 1')} AS client,
         CAST(l_shipdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS product_id,
         l_extendedprice * (1 - l_discount) - l_extendedprice * CAST(0.9 AS DOUBLE) AS prediction
  FROM lineitem"""

SITE_CONFIG = f"""
  SELECT {_pick(td.BID_CLIENTS, 'g + 1')} AS short_name, CAST(g + {td.SITE_ID_BASE} AS BIGINT) AS site_id,
         CAST([{', '.join(repr(x) for x in td.BASE_THRESHOLDS)}][g + 1] AS DOUBLE)
           AS percent_prediction_threshold
  FROM (SELECT DISTINCT CAST(p_partkey % 5 AS INTEGER) AS g FROM part) AS x"""

CATALOG = f"""
  SELECT CAST(p_partkey % 5 + {td.SITE_ID_BASE} AS BIGINT) AS site_id,
         CAST(p_partkey AS VARCHAR) AS product_id, p_brand AS brand, p_type AS category,
         to_base64(encode(CASE WHEN p_partkey % {td.BROKEN_JSON_EVERY} = 0 THEN '{{oops'
              ELSE '{{"price": "' || printf('%.2f', p_retailprice) || '", "cost": "'
                   || printf('%.2f', p_retailprice - p_size) || '", "title": "' || p_name
                   || '", "image_url": "https://img.example.com/' || CAST(p_partkey AS VARCHAR)
                   || '.jpg"}}' END)) AS catalog_json
  FROM part"""


def bid_clients_sql() -> str:
    inner = f"WITH bids AS ({BIDS})\nSELECT DISTINCT client FROM bids WHERE length(client) >= 4"
    return final(inner, [("client", "s")])


def bid_dates_sql() -> str:
    inner = f"WITH bids AS ({BIDS})\nSELECT DISTINCT client, date FROM bids"
    return final(inner, [("client", "s"), ("date", "d")])


def top_products_sql(k: int = 5, pick: int | None = None) -> str:
    fields = ", ".join(
        f"CASE WHEN json_valid(js) THEN json_extract_string(js, '$.{f}') END AS {f}"
        for f in ["price", "cost", "title", "image_url"])
    inner = f"""WITH bids AS ({BIDS}), cfg AS ({SITE_CONFIG}), cat0 AS ({CATALOG}),
cat AS (SELECT site_id, product_id, brand, category, {fields}
        FROM (SELECT *, decode(from_base64(catalog_json)) AS js FROM cat0) AS c),
ranked AS (SELECT client, date, product_id,
                  row_number() OVER (PARTITION BY client, date
                                     ORDER BY prediction DESC NULLS LAST, product_id) AS rank
           FROM bids),
top AS (SELECT client, date, product_id, min(rank) AS rank FROM ranked WHERE rank <= {k}
        GROUP BY 1, 2, 3)
SELECT t.client, t.date, t.rank, t.product_id, cat.brand, cat.category, cat.price, cat.cost,
       cat.title, cat.image_url
FROM top t JOIN cfg ON t.client = cfg.short_name
JOIN cat ON cat.site_id = cfg.site_id AND cat.product_id = t.product_id"""
    if pick is not None:
        inner = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client, date ORDER BY rank, product_id)"
                 f" AS shown FROM ({inner}) AS d) AS s WHERE shown = {pick + 1}")
    return final(inner, [("client", "s"), ("date", "d"), ("rank", "n"), ("product_id", "s"),
                         ("brand", "s"), ("category", "s"), ("price", "s"), ("cost", "s"),
                         ("title", "s"), ("image_url", "s")])


def threshold_sql(grid) -> str:
    """Ranks every row and counts the percentiles under each threshold."""
    g = ", ".join(f"CAST({float(x)!r} AS DOUBLE)" for x in grid)
    inner = f"""WITH bids AS ({BIDS}), cfg AS ({SITE_CONFIG}),
ranked AS (SELECT client, date, CASE WHEN prediction IS NOT NULL THEN
                  CAST(row_number() OVER (PARTITION BY client, date ORDER BY prediction DESC NULLS LAST, product_id)
                       AS DOUBLE) / count(*) OVER (PARTITION BY client, date) END AS percentile FROM bids),
grid AS (SELECT short_name AS client, unnest([{g}]) * percent_prediction_threshold AS threshold FROM cfg)
SELECT r.client, r.date, threshold, count(*) FILTER (percentile < threshold) AS increases
FROM ranked r JOIN grid ON r.client = grid.client GROUP BY ALL"""
    return final(inner, [("client", "s"), ("date", "d"), ("threshold", "f"), ("increases", "i")])


PERF = f"""
  SELECT CAST(l_partkey % 5 + {td.SITE_ID_BASE} AS BIGINT) AS site_id,
         CAST(l_shipdate AS DATE) AS prediction_date,
         'model_' || CAST(l_linenumber % 2 AS VARCHAR) AS model_id,
         CAST(l_partkey % 1001 AS DOUBLE) / 10.0 AS percentile,
         l_extendedprice * l_tax AS cost, l_extendedprice * (1 - l_discount) AS revenue,
         l_tax * 10 AS cum_percent_cost, l_discount * 10 AS cum_percent_revenue
  FROM lineitem"""


def tier_summary_sql(since: str) -> str:
    i = "CAST(ceil(percentile / 5) AS BIGINT)"
    t = (f"CASE WHEN {i} BETWEEN 1 AND 20 AND percentile >= {i} * 5 - 4 "
         f"THEN 'tier_' || CAST({i} AS VARCHAR) END")
    inner = f"""WITH perf AS ({PERF})
SELECT site_id, prediction_date, model_id, tier, sum(cost) AS cost, sum(revenue) AS revenue,
       max(cum_percent_cost) AS cum_percent_cost, max(cum_percent_revenue) AS cum_percent_revenue
FROM (SELECT *, {t} AS tier FROM perf WHERE prediction_date >= DATE '{since}') AS x
WHERE tier IS NOT NULL GROUP BY 1, 2, 3, 4"""
    return final(inner, [("site_id", "i"), ("prediction_date", "d"), ("model_id", "s"),
                         ("tier", "s"), ("cost", "f"), ("revenue", "f"),
                         ("cum_percent_cost", "f"), ("cum_percent_revenue", "f")])


def prediction_choices_sql(since: str) -> str:
    inner = (f"WITH perf AS ({PERF})\nSELECT DISTINCT site_id, prediction_date FROM perf "
             f"WHERE prediction_date >= DATE '{since}'")
    return final(inner, [("site_id", "i"), ("prediction_date", "d")])


# ----------------------------------------------------------- text

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def token_lists(src: str, key: str, text: str = "text") -> str:
    from ..functions.text import MASK_PATTERN, PUNCTUATION
    cleaned = (f"translate(regexp_replace({text}, {_sql_str(MASK_PATTERN)}, '', 'g'), "
               f"{_sql_str(PUNCTUATION)}, '')")
    return f"""
  SELECT {key} AS key, list_transform(list_filter(string_split(trim({cleaned}, chr(10)), ' '),
                                                   lambda x: x <> ''), lambda x: lower(x)) AS w
  FROM {src} WHERE {text} IS NOT NULL"""


def tokens_cte(src: str = "documents", key: str = "doc_id") -> str:
    return f"""tl AS ({token_lists(src, key)}),
toks AS (SELECT key AS {key}, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM tl)"""


def clean_tokens_sql() -> str:
    inner = f"WITH {tokens_cte()}\nSELECT doc_id, pos, word FROM toks"
    return final(inner, [("doc_id", "i"), ("pos", "n"), ("word", "s")])


VOCAB_CTES = """cnt AS (SELECT word, count(*) AS n FROM toks GROUP BY word),
ranked AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS id FROM cnt),
lim AS (SELECT count(*) - 1 AS lim FROM cnt),
vocab AS (SELECT word, id, n FROM ranked WHERE id <= (SELECT lim FROM lim)
          UNION ALL
          SELECT 'UNK', 0, coalesce(sum(n), 0) FROM ranked WHERE id > (SELECT lim FROM lim))"""


def vocabulary_sql() -> str:
    inner = f"WITH {tokens_cte()},\n{VOCAB_CTES}\nSELECT word, id, n FROM vocab"
    return final(inner, [("word", "s"), ("id", "i"), ("n", "i")])


def vocab_stats_sql() -> str:
    inner = f"""WITH {tokens_cte()},\n{VOCAB_CTES},
enc AS (SELECT t.word, coalesce(v.id, 0) AS id FROM toks t
        LEFT JOIN (SELECT word, id FROM vocab WHERE id > 0) v ON t.word = v.word)
SELECT (SELECT count(*) FROM toks) AS tokens, (SELECT count(DISTINCT word) FROM toks)
       AS distinct_words, (SELECT count(*) FROM enc WHERE id = 0) AS unk_tokens"""
    return final(inner, [("tokens", "i"), ("distinct_words", "i"), ("unk_tokens", "i")])


# rows of one key, or of none, are documents of their own
DOCUMENT_IDS = f"""{VOCAB_CTES},
numbered AS (SELECT w, row_number() OVER (ORDER BY key NULLS FIRST) AS d FROM tl),
placed AS (SELECT d, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM numbered),
enc AS (SELECT t.d, t.pos, coalesce(v.id, 0) AS id FROM placed t
        LEFT JOIN (SELECT word, id FROM vocab WHERE id > 0) v ON t.word = v.word)"""


def skipgram_sql(window: int = 1) -> str:
    offs = ", ".join(str(o) for o in range(-window, window + 1) if o != 0)
    inner = f"""WITH {tokens_cte()},\n{DOCUMENT_IDS},
g AS (SELECT id, row_number() OVER (ORDER BY d, pos) - 1 AS g FROM enc),
n AS (SELECT count(*) AS n FROM g),
c AS (SELECT id AS center, (((g + o) % (SELECT n FROM n)) + (SELECT n FROM n)) % (SELECT n FROM n) AS t
      FROM g, (SELECT unnest([{offs}]) AS o) AS offs)
SELECT c.center, x.id AS context FROM c JOIN g x ON c.t = x.g"""
    return final(inner, [("center", "n"), ("context", "n")])


def skipgram_within_sql(window: int) -> str:
    """A document's ids as one list: a pair is a list and itself shifted, no join of tokens."""
    pairs = "\nUNION ALL ".join(
        f"SELECT unnest(ids[{1 + max(0, -o)}:len(ids) - {max(0, o)}]) AS center, "
        f"unnest(ids[{1 + max(0, o)}:len(ids) - {max(0, -o)}]) AS context FROM lists WHERE len(ids) > {abs(o)}"
        for o in range(-window, window + 1) if o != 0)
    inner = f"""WITH {tokens_cte()},\n{DOCUMENT_IDS},
lists AS (SELECT list(id ORDER BY pos) AS ids FROM enc GROUP BY d)
{pairs}"""
    return final(inner, [("center", "n"), ("context", "n")])


def site_config_sql() -> str:
    return final(f"WITH cfg AS ({SITE_CONFIG})\nSELECT * FROM cfg",
                 [("short_name", "s"), ("site_id", "i"), ("percent_prediction_threshold", "f")])


def search_sql(method: str, k: int = 10) -> str:
    from .text import BM25_B, BM25_K1
    if method == "bm25":
        idf = "ln(1 + (N - df + 0.5) / (df + 0.5))"
        score = f"""SELECT query_id, doc_id,
       sum(qtf * idf * tf * {BM25_K1 + 1} / (tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * dl / (SELECT avgdl FROM st))))
         AS score
FROM hits JOIN dl USING (doc_id) GROUP BY 1, 2"""
    else:
        idf = "ln(N / df)"
        score = """SELECT h.query_id, h.doc_id, h.dot / (dn.dn * qn.qn) AS score
FROM (SELECT query_id, doc_id, sum(qtf * tf * idf * idf) AS dot FROM hits GROUP BY 1, 2) h
JOIN (SELECT doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS dn FROM postings JOIN terms USING (term)
      GROUP BY 1) dn ON h.doc_id = dn.doc_id
JOIN (SELECT query_id, sqrt(sum((qtf * idf) * (qtf * idf))) AS qn FROM qt GROUP BY 1) qn
  ON h.query_id = qn.query_id"""
    inner = f"""WITH {tokens_cte()},
ql AS ({token_lists('benchmark', 'item_id')}),
qtok AS (SELECT key AS query_id, unnest(w) AS term FROM ql),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM qtok GROUP BY 1, 2),
postings AS (SELECT word AS term, doc_id, count(*) AS tf FROM toks GROUP BY 1, 2),
dl AS (SELECT key AS doc_id, len(w) AS dl FROM tl),
st AS (SELECT CAST(count(*) AS DOUBLE) AS N, avg(dl) AS avgdl FROM dl),
terms AS (SELECT term, {idf.replace('N', '(SELECT N FROM st)')} AS idf
          FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1) AS d),
qt AS (SELECT q.query_id, q.term, q.qtf, t.idf FROM qterms q JOIN terms t ON q.term = t.term),
hits AS (SELECT qt.query_id, qt.term, qt.qtf, qt.idf, p.doc_id, p.tf FROM qt JOIN postings p
         ON qt.term = p.term),
scores AS ({score})
SELECT query_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM scores) AS r WHERE rank <= {k}"""
    return final(inner, [("query_id", "i"), ("rank", "n"), ("doc_id", "i"), ("score", "f")])


# ----------------------------------------------------------- learn

EMB_X = """x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS xv,
                 unnest(range(0, len(embedding))) AS i FROM embeddings)"""


def _centroid_ctes() -> str:
    return f"""{EMB_X},
c AS (SELECT label AS cls, i, avg(xv) AS mu FROM x GROUP BY 1, 2),
b AS (SELECT cls, -0.5 * sum(mu * mu) AS b FROM c GROUP BY 1),
lg AS (SELECT x.vec_id, c.cls, sum(x.xv * c.mu) + b.b AS logit
       FROM x JOIN c ON x.i = c.i JOIN b ON c.cls = b.cls GROUP BY x.vec_id, c.cls, b.b),
mx AS (SELECT vec_id, max(logit) AS m FROM lg GROUP BY 1),
lse AS (SELECT lg.vec_id, mx.m + ln(sum(exp(lg.logit - mx.m))) AS lse
        FROM lg JOIN mx ON lg.vec_id = mx.vec_id GROUP BY lg.vec_id, mx.m),
pred AS (SELECT vec_id, first(cls ORDER BY logit DESC, cls) AS prediction FROM lg GROUP BY 1),
scored AS (SELECT e.vec_id, e.label, p.prediction, lg.logit - lse.lse AS log_prob
           FROM embeddings e JOIN pred p ON e.vec_id = p.vec_id
           JOIN lse ON e.vec_id = lse.vec_id
           JOIN lg ON lg.vec_id = e.vec_id AND lg.cls = e.label)"""


def classifier_scores_sql() -> str:
    inner = f"WITH {_centroid_ctes()}\nSELECT vec_id, label, prediction, log_prob FROM scored"
    return final(inner, [("vec_id", "i"), ("label", "n"), ("prediction", "n"), ("log_prob", "f")])


def classifier_eval_sql() -> str:
    inner = f"""WITH {_centroid_ctes()}
SELECT count(*) AS n, avg(CAST(label = prediction AS DOUBLE)) AS accuracy,
       1 - avg(CAST(label = prediction AS DOUBLE)) AS error_rate,
       sum(log_prob) AS log_likelihood, -avg(log_prob) AS cross_entropy FROM scored"""
    return final(inner, [("n", "i"), ("accuracy", "f"), ("error_rate", "f"),
                         ("log_likelihood", "f"), ("cross_entropy", "f")])


def holdout_sql(last: int) -> str:
    inner = f"""SELECT vec_id, label,
       CASE WHEN row_number() OVER (ORDER BY vec_id DESC) <= {last} THEN 'test' ELSE 'train' END
         AS split
FROM embeddings"""
    return final(inner, [("vec_id", "i"), ("label", "n"), ("split", "s")])


def mini_batches_sql(batch: int) -> str:
    inner = f"""SELECT vec_id, label, batch FROM (
  SELECT vec_id, label, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / {batch}) AS BIGINT)
           AS batch
  FROM embeddings) AS b
WHERE batch < (SELECT count(*) // {batch} FROM embeddings)"""
    return final(inner, [("vec_id", "i"), ("label", "n"), ("batch", "i")])


def standardized_sql() -> str:
    inner = f"""WITH {EMB_X},
s AS (SELECT i, avg(xv) AS mu, stddev_samp(xv) AS sd FROM x GROUP BY i)
SELECT x.vec_id, x.label, x.i, CASE WHEN s.sd = 0 THEN 0.0 ELSE (x.xv - s.mu) / s.sd END AS z
FROM x JOIN s ON x.i = s.i"""
    return final(inner, [("vec_id", "i"), ("label", "n"), ("i", "n"), ("z", "f")])


def batch_gradient_sql(d: int, m: int, k: int) -> str:
    inner = f"""WITH {EMB_X},
w1 AS (SELECT t1.i, t2.j, CAST(((t1.i * 7 + t2.j * 3) % 11) - 5 AS DOUBLE) / 50.0 AS w
       FROM range(0, {d}) t1(i), range(0, {m}) t2(j)),
w2 AS (SELECT t1.j, t2.c, CAST(((t1.j * 5 + t2.c * 3) % 7) - 3 AS DOUBLE) / 20.0 AS w
       FROM range(0, {m}) t1(j), range(0, {k}) t2(c)),
z AS (SELECT x.vec_id, w1.j, tanh(sum(x.xv * w1.w)) AS z FROM x JOIN w1 ON x.i = w1.i GROUP BY 1, 2),
a AS (SELECT z.vec_id, w2.c, sum(z.z * w2.w) AS a FROM z JOIN w2 ON z.j = w2.j GROUP BY 1, 2),
mx AS (SELECT vec_id, max(a) AS m FROM a GROUP BY 1),
e AS (SELECT a.vec_id, a.c, exp(a.a - mx.m) AS e FROM a JOIN mx ON a.vec_id = mx.vec_id),
y AS (SELECT e.vec_id, e.c, e.e / s.s AS y FROM e JOIN (SELECT vec_id, sum(e) AS s FROM e GROUP BY 1) s
      ON e.vec_id = s.vec_id),
diff AS (SELECT y.vec_id, y.c, CASE WHEN em.label = y.c THEN 1.0 ELSE 0.0 END - y.y AS d
         FROM y JOIN embeddings em ON y.vec_id = em.vec_id),
dz AS (SELECT z.vec_id, z.j, sum(diff.d * w2.w) * (1 - z.z * z.z) AS dz
       FROM z JOIN w2 ON z.j = w2.j JOIN diff ON diff.vec_id = z.vec_id AND diff.c = w2.c
       GROUP BY z.vec_id, z.j, z.z)
SELECT 'W2' AS param, z.j AS i, diff.c AS j, sum(z.z * diff.d) AS value
  FROM z JOIN diff ON z.vec_id = diff.vec_id GROUP BY 2, 3
UNION ALL SELECT 'b2', c, 0, sum(d) FROM diff GROUP BY 2
UNION ALL SELECT 'W1', x.i, dz.j, sum(x.xv * dz.dz) FROM x JOIN dz ON x.vec_id = dz.vec_id GROUP BY 2, 3
UNION ALL SELECT 'b1', j, 0, sum(dz) FROM dz GROUP BY 2"""
    return final(inner, [("param", "s"), ("i", "n"), ("j", "n"), ("value", "f")])


# ----------------------------------------------------------- timesheet

def timesheet_sql(ttl: str | None = None, delay: str = "0 hours") -> str:
    """With ``ttl``, of the rows without a partner only those that the last event's time less ``delay`` has passed by it."""
    ts = "'%Y-%m-%d %H:%M:%S.%f'"
    inner = f"""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
                  'project_' || json_extract_string(props, '$.k') AS Project, ts AS Start
           FROM events WHERE event_type = 'click'),
e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, ts AS "End"
      FROM events WHERE event_type = 'purchase')
SELECT coalesce(s.user_id, e.user_id) AS user_id, coalesce(s.k, e.k) AS k, s.Project,
       strftime(s.Start, {ts}) AS Start, strftime(e."End", {ts}) AS "End",
       CAST(epoch_us(e."End") - epoch_us(s.Start) AS DOUBLE) / 1e6 AS "Time Spent"
FROM s FULL OUTER JOIN e ON s.user_id = e.user_id AND s.k = e.k"""
    if ttl:
        inner += f"""
WHERE (s.k IS NOT NULL AND e.k IS NOT NULL) OR coalesce(s.Start, e."End") + INTERVAL '{ttl}' <= (
  SELECT max(ts) FROM events WHERE event_type IN ('click', 'purchase')) - INTERVAL '{delay}'"""
    return final(inner, [("user_id", "i"), ("k", "i"), ("Project", "s"), ("Start", "s"),
                         ("End", "s"), ("Time Spent", "f")])


def rank_percentile_sql() -> str:
    inner = f"""WITH bids AS ({BIDS})
SELECT client, date, product_id, prediction,
       CASE WHEN prediction IS NOT NULL THEN row_number() OVER (
         PARTITION BY client, date ORDER BY prediction DESC NULLS LAST, product_id) END
         AS predicted_cm_rank,
       CASE WHEN prediction IS NOT NULL THEN row_number() OVER (
         PARTITION BY client, date ORDER BY prediction DESC NULLS LAST, product_id) END
         / count(*) OVER (PARTITION BY client, date) AS predicted_cm_percentile
FROM bids"""
    return final(inner, [("client", "s"), ("date", "d"), ("product_id", "s"), ("prediction", "f"),
                         ("predicted_cm_rank", "n"), ("predicted_cm_percentile", "f")])


def unit_embeddings_sql() -> str:
    inner = """SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i,
       CAST(unnest(embedding) AS DOUBLE) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])) AS value
FROM embeddings"""
    return final(inner, [("vec_id", "i"), ("i", "n"), ("value", "f")])


# ----------------------------------------------------------- rows that exercise one operator each

def classifier_outputs_sql() -> str:
    inner = f"""WITH {_centroid_ctes()}
SELECT lg.vec_id, lg.cls AS class, greatest(lg.logit, 0) AS relu, exp(lg.logit - lse.lse) AS probability,
       CASE WHEN e.label = lg.cls THEN 1.0 ELSE 0.0 END AS target
FROM lg JOIN lse ON lg.vec_id = lse.vec_id JOIN embeddings e ON e.vec_id = lg.vec_id"""
    return final(inner, [("vec_id", "i"), ("class", "n"), ("relu", "f"), ("probability", "f"), ("target", "f")])


def network_steps_sql(d: int, m: int, k: int, steps: int, rate: float, l2: float) -> str:
    """Weights after full-batch steps, and the cost before each."""
    ctes = [EMB_X, f"""w1_0 AS (SELECT t1.i, t2.j, CAST(((t1.i * 7 + t2.j * 3) % 11) - 5 AS DOUBLE) / 50.0 AS w
       FROM range(0, {d}) t1(i), range(0, {m}) t2(j))""",
            f"b1_0 AS (SELECT i, 0 AS j, CAST(0 AS DOUBLE) AS w FROM range(0, {m}) t(i))",
            f"""w2_0 AS (SELECT t1.i, t2.j, CAST(((t1.i * 5 + t2.j * 3) % 7) - 3 AS DOUBLE) / 20.0 AS w
       FROM range(0, {m}) t1(i), range(0, {k}) t2(j))""",
            f"b2_0 AS (SELECT i, 0 AS j, CAST(0 AS DOUBLE) AS w FROM range(0, {k}) t(i))"]
    for s in range(steps):
        ctes += [
            f"""z_{s} AS MATERIALIZED (SELECT x.vec_id, w.j, tanh(sum(x.xv * w.w) + b.w) AS z
       FROM x JOIN w1_{s} w ON x.i = w.i JOIN b1_{s} b ON b.i = w.j GROUP BY x.vec_id, w.j, b.w)""",
            f"""a_{s} AS MATERIALIZED (SELECT z.vec_id, w.j AS c, sum(z.z * w.w) + b.w AS a
       FROM z_{s} z JOIN w2_{s} w ON z.j = w.i JOIN b2_{s} b ON b.i = w.j GROUP BY z.vec_id, w.j, b.w)""",
            f"""t_{s} AS MATERIALIZED (SELECT a.vec_id, any_value(m.m) AS m, sum(exp(a.a - m.m)) AS s FROM a_{s} a
       JOIN (SELECT vec_id, max(a) AS m FROM a_{s} GROUP BY 1) m ON a.vec_id = m.vec_id GROUP BY 1)""",
            f"""diff_{s} AS MATERIALIZED (SELECT a.vec_id, a.c, CASE WHEN e.label = a.c THEN 1.0 ELSE 0.0 END
         - exp(a.a - t.m) / t.s AS d, CASE WHEN e.label = a.c THEN ln(t.s) - (a.a - t.m) ELSE 0 END AS nll
       FROM a_{s} a JOIN t_{s} t ON a.vec_id = t.vec_id JOIN embeddings e ON a.vec_id = e.vec_id)""",
            f"""dz_{s} AS MATERIALIZED (SELECT z.vec_id, z.j, sum(f.d * w.w) * (1 - z.z * z.z) AS dz
       FROM z_{s} z JOIN w2_{s} w ON z.j = w.i JOIN diff_{s} f ON f.vec_id = z.vec_id AND f.c = w.j
       GROUP BY z.vec_id, z.j, z.z)""",
            f"""cost_{s} AS (SELECT (SELECT sum(nll) FROM diff_{s}) + CAST({l2} AS DOUBLE) * (
         (SELECT sum(w * w) FROM w1_{s}) + (SELECT sum(w * w) FROM b1_{s}) + (SELECT sum(w * w) FROM w2_{s})
         + (SELECT sum(w * w) FROM b2_{s})) AS v)"""]
        grads = {"w1": f"SELECT x.i, z.j, sum(x.xv * z.dz) AS g FROM x JOIN dz_{s} z ON x.vec_id = z.vec_id GROUP BY 1, 2",
                 "b1": f"SELECT j AS i, 0 AS j, sum(dz) AS g FROM dz_{s} GROUP BY 1",
                 "w2": f"SELECT z.j AS i, f.c AS j, sum(z.z * f.d) AS g FROM z_{s} z JOIN diff_{s} f "
                       "ON z.vec_id = f.vec_id GROUP BY 1, 2",
                 "b2": f"SELECT c AS i, 0 AS j, sum(d) AS g FROM diff_{s} GROUP BY 1"}
        for name, g in grads.items():
            ctes.append(f"""{name}_{s + 1} AS MATERIALIZED (SELECT w.i, w.j,
       w.w + CAST({rate} AS DOUBLE) * (g.g - 2 * CAST({l2} AS DOUBLE) * w.w) AS w
       FROM {name}_{s} w JOIN ({g}) g ON w.i = g.i AND w.j = g.j)""")
    parts = [f"SELECT '{p.upper() if p[0] == 'w' else p}' AS param, i, j, w AS value FROM {p}_{steps}" for p in ("w1", "b1", "w2", "b2")]
    parts += [f"SELECT 'cost', {s}, 0, v FROM cost_{s}" for s in range(steps)]
    inner = "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts)
    return final(inner, [("param", "s"), ("i", "n"), ("j", "n"), ("value", "f")])


def word_vectors_sql(dim: int, steps: int, negatives: int, rate: float) -> str:
    from .vectors import FACTOR, PRIME
    at = range(dim)

    def rule(k: int, a: int, b: int) -> str:
        return f"((id * {a} + {(k + 1) * b}) % 10007) / CAST(10007 AS DOUBLE) * 2 - 1"

    def drawn(j: int, step: int) -> str:
        h = f"((center * 40503 + context * 30011 + {j * 20021 + step * 10007 + 1}) % {PRIME})"
        for _ in range(3):
            h = f"(({h} * {FACTOR}) % {PRIME})"
        picked = f"CAST(floor(exp({h} / CAST({PRIME} AS DOUBLE) * ln((SELECT v FROM size) + 1))) AS BIGINT) - 1"
        return f"greatest(0, least({picked}, CAST((SELECT v FROM size) AS BIGINT) - 1))"

    ctes = [tokens_cte(), DOCUMENT_IDS, "g AS (SELECT id, row_number() OVER (ORDER BY d, pos) - 1 AS g FROM enc)",
            "len AS (SELECT count(*) AS n FROM g)",
            """c AS (SELECT id AS center, (((g + o) % (SELECT n FROM len)) + (SELECT n FROM len)) % (SELECT n FROM len) AS t
      FROM g, (SELECT unnest([-1, 1]) AS o) AS offs)""",
            """counts AS MATERIALIZED (SELECT c.center, x.id AS context, CAST(count(*) AS DOUBLE) AS n FROM c JOIN g x ON c.t = x.g
      GROUP BY 1, 2)""",
            "size AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS v, (SELECT sum(n) FROM counts) AS n FROM vocab)",
            f"emb_0 AS (SELECT id, [{', '.join(rule(k, 7919, 104729) for k in at)}] AS v FROM vocab)",
            f"out_0 AS (SELECT id, [{', '.join(f'({rule(k, 104729, 7919)}) / CAST({dim ** 0.5!r} AS DOUBLE)' for k in at)}] AS u, "
            "CAST(0 AS DOUBLE) AS b FROM vocab)"]
    for s in range(steps):
        false = " ".join(f"UNION ALL SELECT center, {drawn(j, s)}, 0.0, n FROM counts" for j in range(negatives))
        dot = " + ".join(f"v[{k + 1}] * u[{k + 1}]" for k in at)
        elog = f"ln({negatives} * ln((target + 2) / CAST(target + 1 AS DOUBLE)) / ln((SELECT v FROM size) + 1))"
        ctes += [
            f"""rows_{s} AS (SELECT center, target, y, sum(n) AS n FROM (
         SELECT center, context AS target, 1.0 AS y, n FROM counts {false}) AS r GROUP BY 1, 2, 3)""",
            f"""pulled_{s} AS MATERIALIZED (SELECT center, target, v, u,
         (CAST(y AS DOUBLE) - 1 / (1 + exp(-({dot} + b - {elog})))) * n / (SELECT n FROM size) AS g
       FROM rows_{s} r JOIN emb_{s} e ON r.center = e.id JOIN out_{s} o ON r.target = o.id)"""]
        for table, by, own, side in (("emb", "center", "v", "u"), ("out", "target", "u", "v")):
            sums = ", ".join(f"sum(g * {side}[{k + 1}]) AS d{k}" for k in at)
            moved = ", ".join(f"t.{own}[{k + 1}] + CAST({rate} AS DOUBLE) * d.d{k}" for k in at)
            bias = "" if table == "emb" else f", t.b + CAST({rate} AS DOUBLE) * coalesce(d.db, 0) AS b"
            ctes.append(f"""{table}_{s + 1} AS MATERIALIZED (SELECT t.id, CASE WHEN d.id IS NULL THEN t.{own} ELSE [{moved}] END AS {own}{bias}
       FROM {table}_{s} t LEFT JOIN (SELECT {by} AS id, sum(g) AS db, {sums} FROM pulled_{s} GROUP BY 1) d ON t.id = d.id)""")
    norm = "sqrt(" + " + ".join(f"v[{k + 1}] * v[{k + 1}]" for k in at) + ")"
    inner = "WITH " + ",\n".join(ctes) + f"""
SELECT id, unnest(range(0, {dim})) AS i, unnest([{', '.join(f'v[{k + 1}] / {norm}' for k in at)}]) AS value FROM emb_{steps}"""
    return final(inner, [("id", "i"), ("i", "n"), ("value", "f")])


def document_vectors_sql(dim: int) -> str:
    inner = f"""WITH {tokens_cte()},\n{VOCAB_CTES},
enc AS (SELECT t.doc_id, coalesce(v.id, 0) AS id FROM toks t
        LEFT JOIN (SELECT word, id FROM vocab WHERE id > 0) v ON t.word = v.word),
means AS (SELECT doc_id, count(*) AS n, [{', '.join(f'avg(CAST(embedding[{k + 1}] AS DOUBLE))' for k in range(dim))}] AS m
          FROM enc JOIN embeddings ON id = vec_id GROUP BY doc_id)
SELECT doc_id, n, unnest(range(0, {dim})) AS i, unnest(m) AS value FROM means"""
    return final(inner, [("doc_id", "i"), ("n", "i"), ("i", "n"), ("value", "f")])


def distinct_words_sql() -> str:
    inner = f"""WITH tl AS (SELECT source, w FROM ({token_lists('documents', 'doc_id').replace('SELECT doc_id AS key', 'SELECT source')})),
toks AS (SELECT source, unnest(w) AS word FROM tl)
SELECT source, count(DISTINCT word) AS words, TRUE AS near, TRUE AS merged_near FROM toks GROUP BY source"""
    return final(inner, [("source", "s"), ("words", "i"), ("near", "b"), ("merged_near", "b")])


def documents_files_sql() -> str:
    src = """(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id,
          CASE WHEN doc_id % 4 IN (1, 2) THEN chr(65279) || text ELSE text END AS text FROM documents WHERE text IS NOT NULL) AS f"""
    inner = f"WITH {tokens_cte(src)}\nSELECT doc_id, pos, word FROM toks"
    return final(inner, [("doc_id", "i"), ("pos", "n"), ("word", "s")])


def monthly_bids_sql(columns: str = "client, date, product_id, prediction") -> str:
    distinct = "DISTINCT " if "prediction" not in columns else ""
    inner = f"""WITH bids AS ({BIDS})
SELECT {distinct}{columns} FROM (SELECT client, CAST(date_trunc('month', date) AS DATE) AS date, product_id, prediction FROM bids) AS m"""
    kinds = {"client": "s", "date": "d", "product_id": "s", "prediction": "f"}
    return final(inner, [(c, kinds[c]) for c in columns.split(", ")])


def registry_positions_sql() -> str:
    inner = f"""SELECT short_name, row_number() OVER (ORDER BY short_name) AS position
FROM (SELECT DISTINCT {client_expr()} AS short_name FROM events) AS c"""
    return final(inner, [("short_name", "s"), ("position", "n")])


def holdout_orders_sql(last: int) -> str:
    inner = f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey DESC) <= {last} THEN 'test' ELSE 'train' END
         AS split FROM orders"""
    return final(inner, [("o_orderkey", "i"), ("split", "s")])
