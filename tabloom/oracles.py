"""The registered queries in SQL, for a second engine over the same tables. Written apart from the operators."""

from __future__ import annotations

from . import constants as k
from .registry import PRIORITIES, PROFILED

ORACLES: dict[str, str] = {}

RAW_ORDERS = """
raw_orders AS (
  SELECT 'ORD-' || o_orderkey AS "Order ID",
         CASE o_orderstatus WHEN 'F' THEN 'Sim' WHEN 'O' THEN ' não' END AS "Paid",
         'R$ ' || CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS "Total Price",
         strftime(o_orderdate, '%d/%m/%Y') AS "orderDate",
         lower(regexp_replace(o_orderpriority, '^.*-', '')) || ', '
           || CASE WHEN o_orderstatus = 'P' THEN 'plástico' ELSE 'rede' END AS tags,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'Medium'
              WHEN '5-LOW' THEN ' low ' END AS level,
         'order ' || o_orderkey || ' was placed by customer ' || o_custkey || ' and is still to be shipped' AS note,
         CAST(NULL AS VARCHAR) AS _c7
  FROM orders)
"""

# ---- transforms ---------------------------------------------------------------------------------------------------

ORACLES["yes_no_share_by_group"] = """
SELECT l_linestatus AS "group", l_returnflag = 'R' AS value, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 9) AS share
FROM lineitem GROUP BY 1, 2"""

ORACLES["to_boolean_given_words"] = """
SELECT o_orderkey, lower(trim(o_orderstatus)) IN ('f', 'o') AS flag FROM orders"""

ORACLES["to_boolean_default_words"] = f"""
WITH {RAW_ORDERS} SELECT "Order ID" AS order_id, CASE WHEN "Paid" = 'Sim' THEN true WHEN "Paid" = ' não' THEN false END
AS paid_flag FROM raw_orders"""

ORACLES["to_boolean_numbers"] = "SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic FROM labels"

ORACLES["parse_numeric_strings"] = """
SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(15,2)) AS DOUBLE) AS price FROM part"""

ORACLES["parse_numeric_decimal_comma"] = """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS price FROM orders"""

ORACLES["parse_dates_mixed"] = """
SELECT o_orderkey, CAST(coalesce(try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%d/%m/%Y')) AS TIMESTAMP) AS day
FROM (SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders)"""

ORACLES["parse_dates_day_first"] = """
SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day FROM orders"""

ORACLES["parse_dates_explicit"] = """
SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS moment FROM events"""

ORACLES["parse_dates_by_column_unlisted"] = """
SELECT o_orderkey,
       CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) + CASE WHEN o_orderkey % 3 = 1 THEN INTERVAL '870 minutes'
            ELSE INTERVAL '0 minutes' END AS day,
       CASE WHEN o_orderkey % 11 > 0 THEN CAST(date_trunc('minute', o_orderdate) AS TIMESTAMP) END AS shipped
FROM orders"""

ORACLES["parse_dates_by_column_order"] = """
SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS moment FROM events"""

ORACLES["date_shapes_orders"] = """
WITH d AS (SELECT o_orderkey AS k, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) % 100 AS y FROM orders),
     -- Of the short year and the day, which the name of the month separates, either may come first.
     shapes AS (
       SELECT 'day' AS name, 'C' AS layout, '' AS mark, '%Y%m%d' AS pattern, count(*) AS n_values, count(*) AS n_read,
              -- 2007 may be the 20th of July.
              count(*) FILTER (WHERE y BETWEEN 1 AND 12) AS n_next, 'values' AS settled_by FROM d WHERE k % 3 = 0
       UNION ALL
       SELECT 'day', 'NMN', ' ', '%d %b %y', count(*), count(*),
              count(*) FILTER (WHERE y BETWEEN 1 AND 31 AND TRY_CAST(
                  printf('%04d-%02d-%02d', d + CASE WHEN d >= 69 THEN 1900 ELSE 2000 END, m, y) AS DATE) IS NOT NULL),
              'values' FROM d WHERE k % 3 = 1
       UNION ALL
       SELECT 'day', 'YNN', ' ', '%Y %m %d', count(*), count(*), count(*) FILTER (WHERE d <= 12), 'values'
       FROM d WHERE k % 3 = 2
       UNION ALL
       SELECT 'shipped', 'NNY', '.', '%d.%m.%Y', count(*), count(*), count(*) FILTER (WHERE d <= 12), 'values'
       FROM d WHERE k % 11 > 0
       UNION ALL
       SELECT 'shipped', NULL, NULL, NULL, count(*), 0, 0, NULL FROM d WHERE k % 11 = 0 AND k % 2 = 0)
SELECT * FROM shapes WHERE n_values > 0"""

ORACLES["extract_date_features"] = """
SELECT event_id, CAST(year(ts) AS INTEGER) AS t_year, CAST(month(ts) AS INTEGER) AS t_month,
       CAST(day(ts) AS INTEGER) AS t_day, dayname(ts) AS t_weekday, CAST(hour(ts) AS INTEGER) AS t_hour
FROM events"""

ORACLES["extract_date_features_from_text"] = """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS INTEGER) AS day_year,
       CAST(month(o_orderdate) AS INTEGER) AS day_month, CAST(day(o_orderdate) AS INTEGER) AS day_day,
       dayname(o_orderdate) AS day_weekday, CAST(0 AS INTEGER) AS day_hour
FROM orders"""

ORACLES["bin_numeric_equal_width"] = """
WITH s AS (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part),
e AS (SELECT i + 1 AS bin, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + i * (hi - lo) / 5 END AS lo,
             lo + (i + 1) * (hi - lo) / 5 AS hi FROM s, range(5) r(i))
SELECT p_partkey, p_size, CAST(bin AS INTEGER) AS bin, round(lo, 9) AS lo, round(hi, 9) AS hi
FROM part JOIN e ON p_size > lo AND p_size <= hi"""

ORACLES["bin_numeric_labelled_edges"] = """
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_totalprice < 1000 THEN NULL WHEN o_totalprice <= 50000 THEN 'low'
            WHEN o_totalprice <= 150000 THEN 'middle' WHEN o_totalprice <= 400000 THEN 'high' END AS band
FROM orders"""

ORACLES["normalize_minmax"] = """
SELECT c_custkey, c_acctbal,
       round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9)
         AS c_acctbal_minmax FROM customer"""

ORACLES["normalize_zscore"] = """
SELECT c_custkey, c_acctbal, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 8)
         AS c_acctbal_zscore FROM customer"""

ORACLES["encode_onehot"] = "SELECT c_custkey, c_mktsegment, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"seg_{s}\""
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer"

ORACLES["encode_label"] = """
SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer"""

ORACLES["encode_label_large_dictionary"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       dense_rank() OVER (ORDER BY l_partkey) - 1 AS code FROM lineitem"""

ORACLES["encode_label_with_nulls"] = f"""
WITH {RAW_ORDERS}, codes AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code
                             FROM (SELECT DISTINCT level FROM raw_orders WHERE level IS NOT NULL))
SELECT "Order ID" AS order_id, level, coalesce(code, -1) AS code FROM raw_orders LEFT JOIN codes USING (level)"""

ORACLES["encode_frequency"] = """
SELECT o_orderkey, o_orderpriority,
       round(count(*) OVER (PARTITION BY o_orderpriority) / count(*) OVER (), 9) AS freq FROM orders"""

ORACLES["encode_frequency_large_dictionary"] = """
SELECT o_orderkey, o_custkey, round(count(*) OVER (PARTITION BY o_custkey) / count(*) OVER (), 9) AS freq FROM orders"""

_ORDER = ", ".join(f"'{p.lower()}'" for p in PRIORITIES)
ORACLES["make_ordinal_given_order"] = f"""
SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority,
       CAST(list_position([{_ORDER}], lower(o_orderpriority)) - 1 AS INTEGER) AS o_orderpriority_rank FROM orders"""

ORACLES["make_ordinal_known_scale"] = f"""
WITH {RAW_ORDERS} SELECT "Order ID" AS order_id, lower(trim(level)) AS level,
       CAST(list_position(['low', 'medium', 'high'], lower(trim(level))) - 1 AS INTEGER) AS level_rank
FROM raw_orders"""

# ---- tags ---------------------------------------------------------------------------------------------------------

_NAME_WORDS = ["anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring",
               "rod", "small", "widget"]
ORACLES["explode_tags_part_names"] = "SELECT p_partkey, p_name, " + ", ".join(
    f"CAST(list_contains(string_split(p_name, ' '), '{w}') AS INTEGER) AS \"t_{w}\"" for w in _NAME_WORDS) + " FROM part"

ORACLES["explode_tags_found_separator"] = f"""
WITH {RAW_ORDERS} SELECT "Order ID" AS order_id, tags, CAST(tags LIKE 'high,%' AS INTEGER) AS t_high,
       CAST(tags LIKE 'low,%' AS INTEGER) AS t_low, CAST(tags LIKE 'medium,%' AS INTEGER) AS t_medium,
       CAST(tags LIKE 'not specified,%' AS INTEGER) AS t_not_specified,
       CAST(tags LIKE '%plástico' AS INTEGER) AS t_pl_stico, CAST(tags LIKE '%rede' AS INTEGER) AS t_rede,
       CAST(tags LIKE 'urgent,%' AS INTEGER) AS t_urgent
FROM raw_orders"""

_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)"


def _cells(table: str, column: str, sep: str, key: str) -> str:
    return (f"SELECT {key}, tag FROM (SELECT {key}, trim(unnest(string_split({column}, '{sep}')), {_BLANKS}) AS tag "
            f"FROM {table}) WHERE tag <> '' AND lower(tag) <> 'nan'")


ORACLES["tags_long_part_names"] = _cells("part", "p_name", " ", "p_partkey")
ORACLES["tag_vocabulary_documents"] = f"SELECT DISTINCT tag FROM ({_cells('documents', 'text', ',', 'doc_id')})"
for _name, _table, _column, _sep, _key in (("part_names", "part", "p_name", " ", "p_partkey"),
                                           ("documents", "documents", "text", ",", "doc_id")):
    ORACLES[f"tag_frequency_{_name}"] = f"""
SELECT tag, count(DISTINCT {_key}) AS n FROM ({_cells(_table, _column, _sep, _key)}) GROUP BY tag"""

ORACLES["tag_cooccurrence_part_names"] = f"""
WITH c AS (SELECT DISTINCT * FROM ({_cells('part', 'p_name', ' ', 'p_partkey')}))
SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM c a JOIN c b ON a.p_partkey = b.p_partkey AND a.tag < b.tag
GROUP BY 1, 2"""
ORACLES["tag_cooccurrence_orders"] = f"""
WITH {RAW_ORDERS}, c AS (SELECT DISTINCT * FROM ({_cells('raw_orders', 'tags', ',', '"Order ID"')}))
SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM c a JOIN c b
ON a."Order ID" = b."Order ID" AND a.tag < b.tag GROUP BY 1, 2"""


def _separator(source: str, column: str) -> str:
    tests = " ".join(
        f"WHEN avg(CAST(contains({column}, '{s}') AS INTEGER)) > 0.25 "
        f"AND avg(len(string_split({column}, '{s}'))) > 1.3 THEN '{s}'" for s in k.TAG_SEPARATORS)
    return f"SELECT '{source}' AS source, '{column}' AS \"column\", CASE {tests} END AS separator FROM {source}"


ORACLES["tag_separators"] = " UNION ALL ".join(_separator(s, c) for s, c in (
    ("documents", "text"), ("part", "p_name"), ("events", "props"), ("conversations", "text"), ("pages", "url")))

# ---- tables behind charts -----------------------------------------------------------------------------------------

ORACLES["key_metrics"] = "SELECT count(*) AS n_rows, " + ", ".join(
    f"count({c}) AS {c}_count, round(sum({c}), 4) AS {c}_sum, round(avg({c}), 4) AS {c}_mean, "
    f"round(min({c}), 4) AS {c}_min, round(max({c}), 4) AS {c}_max"
    for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem"

ORACLES["group_summary"] = """
SELECT event_type, count(*) AS n_rows, count(value) AS value_count, round(avg(value), 6) AS value_mean,
       round(stddev_samp(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max
FROM events GROUP BY event_type"""

ORACLES["value_distribution_status"] = """
SELECT o_orderstatus AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM orders GROUP BY 1"""

ORACLES["value_distribution_with_nulls"] = f"""
WITH {RAW_ORDERS} SELECT level AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM raw_orders GROUP BY 1"""


def _distribution(table: str, column: str, condition: str = "true", name: str | None = None) -> str:
    return (f"SELECT '{name or column}' AS \"column\", CAST({column} AS VARCHAR) AS value, count(*) AS n, "
            f"round(count(*) / sum(count(*)) OVER (), 9) AS share FROM {table} WHERE {column} IS NOT NULL "
            f"AND {condition} GROUP BY 2")


ORACLES["distributions"] = " UNION ALL ".join(
    _distribution("lineitem", c) for c in ("l_returnflag", "l_linestatus", "l_linenumber"))

ORACLES["crosstab"] = """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
       count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1"""

ORACLES["crosstab_long"] = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2"

ORACLES["histogram"] = """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
e AS (SELECT i + 1 AS bin, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + i * ((hi - lo) / 12) END AS lo,
             CASE WHEN i = 11 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 12) END AS hi FROM s, range(12) r(i))
SELECT CAST(bin AS INTEGER) AS bin, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi,
       count(l_extendedprice) AS n
FROM e LEFT JOIN lineitem ON l_extendedprice > lo AND l_extendedprice <= hi GROUP BY bin"""

ORACLES["histogram_given_edges"] = """
WITH e AS (SELECT i + 1 AS bin, CAST(i * 10 AS DOUBLE) AS lo, CAST(i * 10 + 10 AS DOUBLE) AS hi FROM range(7) r(i))
SELECT CAST(bin AS INTEGER) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(l_quantity) AS n
FROM e LEFT JOIN lineitem ON (l_quantity > lo OR (bin = 1 AND l_quantity = lo)) AND l_quantity <= hi GROUP BY bin"""


def _box(table: str, column: str, by: str | None) -> str:
    group = f"{by} AS g" if by else "1 AS g"
    shown = f"q.g AS {by}, " if by else ""
    return f"""
WITH x AS (SELECT {group}, {column} AS x FROM {table} WHERE {column} IS NOT NULL),
q AS (SELECT g, count(*) AS n, min(x) AS lo, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3, max(x) AS hi FROM x GROUP BY g),
f AS (SELECT g, q1 - 1.5 * (q3 - q1) AS a, q3 + 1.5 * (q3 - q1) AS b FROM q)
SELECT {shown}any_value(n) AS n, any_value(lo) AS "min", round(any_value(q1), 6) AS q1,
       round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, any_value(hi) AS "max",
       min(x) FILTER (x >= a AND x <= b) AS whisker_low, max(x) FILTER (x >= a AND x <= b) AS whisker_high,
       count(*) FILTER (x < a OR x > b) AS n_outliers
FROM q JOIN f ON q.g = f.g JOIN x ON x.g = q.g GROUP BY q.g"""


ORACLES["box_statistics"] = _box("orders", "o_totalprice", None)
ORACLES["box_statistics_by_group"] = _box("events", "value", "event_type")

ORACLES["quantiles_of_many_groups"] = """
SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 8) AS mean, round(stddev_samp(o_totalprice), 6) AS std,
       min(o_totalprice) AS "min", max(o_totalprice) AS "max", round(quantile_cont(o_totalprice, 0.1), 8) AS q0,
       round(quantile_cont(o_totalprice, 0.5), 8) AS q1, round(quantile_cont(o_totalprice, 0.9), 8) AS q2
FROM orders GROUP BY o_custkey"""

ORACLES["scatter_sample"] = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 500"""

_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ORACLES["correlation_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 8) AS r FROM lineitem" for a in _MEASURES for b in _MEASURES)

ORACLES["time_trend_monthly"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n,
       round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1"""

ORACLES["time_trend_hourly_filled"] = """
WITH e AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, value FROM events WHERE event_type = 'error'),
hours AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS period FROM e)
SELECT period, count(h) AS n, round(coalesce(sum(value), 0.0), 6) AS total, round(avg(value), 6) AS mean
FROM hours LEFT JOIN e ON h = period GROUP BY period"""

ORACLES["ordinal_distribution"] = f"""
WITH l AS (SELECT unnest([{_ORDER}]) AS level)
SELECT CAST(list_position([{_ORDER}], level) - 1 AS INTEGER) AS rank, level, count(o_orderkey) AS n,
       round(count(o_orderkey) / sum(count(o_orderkey)) OVER (), 9) AS share
FROM l LEFT JOIN orders ON lower(o_orderpriority) = level GROUP BY level"""

ORACLES["ordinal_distribution_known_scale"] = f"""
WITH {RAW_ORDERS}, l AS (SELECT unnest(['low', 'medium', 'high']) AS known)
SELECT CAST(list_position(['low', 'medium', 'high'], known) - 1 AS INTEGER) AS rank, known AS level, count(note) AS n,
       round(count(note) / sum(count(note)) OVER (), 9) AS share
FROM l LEFT JOIN raw_orders ON lower(trim(level)) = known GROUP BY known"""

ORACLES["filtered_distribution"] = """
SELECT l_linenumber AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'O' GROUP BY 1"""

# ---- cleaning -----------------------------------------------------------------------------------------------------

ORACLES["clean_headers"] = f"""
WITH {RAW_ORDERS} SELECT "Order ID" AS order_id, "Paid" AS paid, "Total Price" AS total_price,
       "orderDate" AS order_date, tags, level, note, _c7 AS column_8 FROM raw_orders"""

ORACLES["drop_junk_rows"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority
FROM orders WHERE o_orderstatus = 'F'"""

ORACLES["drop_empty"] = f"""
WITH {RAW_ORDERS} SELECT "Paid", level FROM raw_orders WHERE "Paid" IS NOT NULL OR level IS NOT NULL"""

ORACLES["merge_rename_filter"] = f"""
WITH {RAW_ORDERS} SELECT "Order ID" AS order_id, concat_ws('/', "Paid", level) AS state FROM raw_orders
WHERE "Paid" IS NOT NULL OR level IS NOT NULL"""

ORACLES["missing_values"] = f"""
WITH {RAW_ORDERS} SELECT "Order ID" AS order_id, coalesce("Paid", '?') AS paid, level FROM raw_orders
WHERE level IS NOT NULL"""

ORACLES["fill_missing_mean"] = """
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders)
SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM p)), 4) AS price FROM p"""

# ---- profile ------------------------------------------------------------------------------------------------------


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_SCALES = "[" + ", ".join(_list(s) for s in k.ORDINAL_SCALES) + "]"
_THRESHOLD = ("CASE WHEN n_total <= 50 THEN greatest(n_total // 2, 10) WHEN n_total <= 500 THEN 30 "
              "ELSE least(50, CAST(floor(n_total * 0.05) AS BIGINT)) END")
_NO_EXTRAS = ("CAST(NULL AS VARCHAR) AS tag_separator, CAST(NULL AS BIGINT) AS n_tags, "
              "CAST(NULL AS VARCHAR) AS vocabulary")


def _number_profile(source: str, name: str) -> str:
    return f"""
SELECT '{name}' AS name, semantic_type, n_filled < n_total AS nullable, n_unique, n_total, n_total - n_filled AS n_null,
       {_NO_EXTRAS}, CASE WHEN semantic_type = 'boolean' THEN '1' END AS yes,
       CASE WHEN semantic_type = 'boolean' THEN '0' END AS no,
       CAST(NULL AS VARCHAR) AS scale, CAST(NULL AS VARCHAR) AS numeric_prefix, CAST(NULL AS VARCHAR) AS numeric_suffix,
       CASE WHEN semantic_type = 'categorical' THEN categories END AS categories,
       CAST(NULL AS VARCHAR) AS date_format_hint, CAST(NULL AS DOUBLE) AS avg_length
FROM (SELECT *, CASE WHEN n_unique = 2 AND lo = 0 AND hi = 1 THEN 'boolean' WHEN n_unique <= {_THRESHOLD}
                     THEN 'categorical' ELSE 'numeric' END AS semantic_type
      FROM (SELECT count(*) AS n_total, count("{name}") AS n_filled, count(DISTINCT "{name}") AS n_unique,
                   min("{name}") AS lo, max("{name}") AS hi,
                   (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST("{name}" AS VARCHAR) AS v
                    FROM {source})) AS categories
            FROM {source}))"""


def _date_profile(source: str, name: str) -> str:
    return f"""
SELECT '{name}' AS name, 'datetime' AS semantic_type, count("{name}") < count(*) AS nullable,
       count(DISTINCT "{name}") AS n_unique, count(*) AS n_total, count(*) - count("{name}") AS n_null, {_NO_EXTRAS},
       CAST(NULL AS VARCHAR) AS yes, CAST(NULL AS VARCHAR) AS no, CAST(NULL AS VARCHAR) AS scale,
       CAST(NULL AS VARCHAR) AS numeric_prefix, CAST(NULL AS VARCHAR) AS numeric_suffix,
       CAST(NULL AS VARCHAR) AS categories, CAST(NULL AS VARCHAR) AS date_format_hint,
       CAST(NULL AS DOUBLE) AS avg_length FROM {source}"""


def _text_profile(source: str, name: str) -> str:
    dates = "coalesce(" + ", ".join(f"try_strptime(t, '{f}')" for f in (
        "%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%d/%m/%Y", "%m.%d.%Y", "%d.%m.%Y")) + ")"
    measures = ", ".join(
        f"avg(CAST(contains(s, '{sep}') AS INTEGER)) AS h{i}, avg(len(string_split(s, '{sep}'))) AS p{i}, "
        f"avg(len(string_split(t, '{sep}'))) AS q{i}" for i, sep in enumerate(k.TAG_SEPARATORS))
    sep = "CASE " + " ".join(f"WHEN h{i} > 0.25 AND p{i} > 1.3 AND q{i} > 1.2 THEN '{s}'"
                             for i, s in enumerate(k.TAG_SEPARATORS)) + " END"
    cleaned = f"regexp_replace(t, '[{k.CURRENCY_CHARS}\\s,%]', '', 'g')"
    number = rf"regexp_full_match({cleaned}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"
    affix = lambda pattern: f"nullif(trim(regexp_extract(t, '{pattern}')), '')"
    return f"""
SELECT name, semantic_type, n_filled < n_total AS nullable, n_unique, n_total, n_total - n_filled AS n_null,
       CASE WHEN is_tags THEN sep END AS tag_separator, CASE WHEN is_tags THEN n_tags END AS n_tags,
       CASE WHEN is_tags AND n_tags <= 1000 THEN vocab END AS vocabulary,
       CASE WHEN semantic_type = 'boolean' THEN array_to_string(list_sort(list_intersect(spoken, {_list(k.TRUE_WORDS)})),
            '|') END AS yes,
       CASE WHEN semantic_type = 'boolean' THEN array_to_string(list_sort(list_intersect(spoken, {_list(k.FALSE_WORDS)})),
            '|') END AS no,
       CASE WHEN semantic_type = 'ordinal' THEN array_to_string(scale, '|') END AS scale,
       CASE WHEN semantic_type = 'numeric_string' THEN
            coalesce(CASE WHEN n_prefix > 0.4 * n_filled THEN prefix END, '') END AS numeric_prefix,
       CASE WHEN semantic_type = 'numeric_string' THEN
            coalesce(CASE WHEN n_suffix > 0.4 * n_filled THEN suffix END, '') END AS numeric_suffix,
       CASE WHEN semantic_type = 'ordinal' THEN array_to_string(scale, '|')
            WHEN semantic_type = 'categorical' AND n_unique <= 1000 THEN coalesce(texts, '') END AS categories,
       CASE WHEN semantic_type <> 'date_string' THEN NULL
            WHEN regexp_matches(first_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN '%Y-%m-%d'
            WHEN regexp_matches(first_date, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN '%m/%d/%Y'
            ELSE 'other' END AS date_format_hint,
       round(avg_length, 6) AS avg_length
FROM (SELECT *, semantic_type = 'multi_value_tags' AS is_tags FROM (
 SELECT *, CASE
  WHEN n_filled = 0 THEN 'categorical'
  WHEN len(spoken) BETWEEN 1 AND 3 AND len(list_intersect(spoken, {_list(k.TRUE_WORDS)})) > 0
       AND len(list_intersect(spoken, {_list(k.FALSE_WORDS)})) > 0
       AND len([w FOR w IN spoken IF NOT list_contains({_list(k.TRUE_WORDS + k.FALSE_WORDS)}, w)]) = 0 THEN 'boolean'
  WHEN n_number > 0.6 * n_filled THEN 'numeric_string'
  WHEN n_date > 0.5 * n_filled THEN 'date_string'
  WHEN sep IS NOT NULL AND n_tags >= 2 THEN 'multi_value_tags'
  WHEN scale IS NOT NULL THEN 'ordinal'
  WHEN n_unique <= {_THRESHOLD} THEN 'categorical'
  WHEN n_unique > 0.9 * n_total THEN CASE WHEN avg_length > 50 THEN 'free_text' ELSE 'identifier' END
  WHEN avg_length > 80 THEN 'free_text' ELSE 'categorical' END AS semantic_type
 FROM (
  SELECT b.*, t.*, n_prefix, n_suffix, scale, [w FOR w IN words IF w <> '' AND w <> 'nan'] AS spoken
  FROM (SELECT '{name}' AS name, *, {sep} AS sep FROM (
      SELECT (SELECT count(*) FROM {source}) AS n_total, count(*) AS n_filled, count(DISTINCT s) AS n_unique,
             count(*) FILTER ({number}) AS n_number, count({dates}) AS n_date, min(t) FILTER ({dates} IS NOT NULL)
             AS first_date, avg(length(t)) AS avg_length, list(DISTINCT lower(t)) AS words,
             string_agg(DISTINCT t, '|' ORDER BY t) AS texts, mode({affix('^[^0-9+-]+')}) AS prefix,
             mode({affix('[^0-9]+$')}) AS suffix, {measures}
      FROM (SELECT "{name}" AS s, trim("{name}", {_BLANKS}) AS t FROM {source} WHERE "{name}" IS NOT NULL))) b
  LEFT JOIN LATERAL (SELECT count(DISTINCT tag) AS n_tags, string_agg(DISTINCT tag, '|' ORDER BY tag) AS vocab
       FROM (SELECT trim(unnest(string_split(trim("{name}", {_BLANKS}), b.sep)), {_BLANKS}) AS tag FROM {source})
       WHERE tag <> '') t ON true
  LEFT JOIN LATERAL (SELECT count(*) FILTER (p = b.prefix) AS n_prefix, count(*) FILTER (x = b.suffix) AS n_suffix
       FROM (SELECT {affix('^[^0-9+-]+')} AS p, {affix('[^0-9]+$')} AS x
             FROM (SELECT trim("{name}", {_BLANKS}) AS t FROM {source}))) a ON true
  LEFT JOIN LATERAL (SELECT CASE WHEN len(b.words) BETWEEN 2 AND 15 THEN 
       [w FOR w IN ([c FOR c IN {_SCALES} IF list_has_all(c, b.words)])[1] IF list_contains(b.words, w)] END AS scale)
       c ON true)))"""


_KINDS = {
    "region": {"r_regionkey": "n", "r_name": "t"},
    "nation": {"n_nationkey": "n", "n_name": "t", "n_regionkey": "n"},
    "customer": {"c_custkey": "n", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "t"},
    "supplier": {"s_suppkey": "n", "s_name": "t", "s_nationkey": "n", "s_acctbal": "n"},
    "part": {"p_partkey": "n", "p_name": "t", "p_brand": "t", "p_type": "t", "p_size": "n", "p_retailprice": "n"},
    "orders": {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderdate": "d",
               "o_orderpriority": "t"},
    "lineitem": {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n",
                 "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "t", "l_linestatus": "t",
                 "l_shipdate": "d"},
    "events": {"event_id": "n", "ts": "d", "user_id": "n", "event_type": "t", "value": "n", "props": "t"},
    "documents": {"doc_id": "n", "text": "t", "lang": "t", "source": "t", "n_chars": "n"},
    "pages": {"page_id": "n", "url": "t", "html": "t"},
    "benchmark": {"item_id": "n", "text": "t"},
    "labels": {"doc_id": "n", "quality": "n", "toxic": "n"},
    "conversations": {"conv_id": "n", "turn": "n", "role": "t", "text": "t"},
    "raw_orders": {"Order ID": "t", "Paid": "t", "Total Price": "t", "orderDate": "t", "tags": "t", "level": "t",
                   "note": "t", "_c7": "t"},
}


def _profile(source: str) -> str:
    make = {"n": _number_profile, "t": _text_profile, "d": _date_profile}
    return " UNION ALL ".join(f"SELECT * FROM ({make[kind](source, name)})" for name, kind in _KINDS[source].items())


for _source in PROFILED:
    ORACLES[f"profile_{_source}"] = _profile(_source)
ORACLES["profile_raw_orders"] = f"WITH {RAW_ORDERS} {_profile('raw_orders')}"

ORACLES["column_overview"] = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS n_filled, count(DISTINCT {c}) AS n_unique FROM orders"
    for c in _KINDS["orders"])

ORACLES["dataset_metrics"] = "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem"

ORACLES["type_distribution"] = f"""
WITH {RAW_ORDERS} SELECT semantic_type, count(*) AS n FROM ({_profile('raw_orders')}) GROUP BY 1"""

ORACLES["dominant_type"] = f"""
SELECT semantic_type, count(*) AS n FROM ({_profile('lineitem')}) GROUP BY 1 ORDER BY n DESC LIMIT 1"""

ORACLES["profile_table"] = f"""
WITH {RAW_ORDERS}
SELECT name, semantic_type, n_unique, nullable,
       CASE semantic_type
         WHEN 'boolean' THEN 'true=[' || '''' || replace(yes, '|', ''', ''') || '''' || '], false=[' || ''''
                             || replace(no, '|', ''', ''') || '''' || ']'
         WHEN 'multi_value_tags' THEN 'sep=''' || tag_separator || ''', ' || n_tags || ' tags: [''' ||
              replace(vocabulary, '|', ''', ''') || ''']'
         WHEN 'categorical' THEN n_unique || ' categories: [' ||
              CASE WHEN categories = '' THEN '' ELSE '''' || replace(categories, '|', ''', ''') || '''' END || ']'
         WHEN 'ordinal' THEN replace(scale, '|', ' → ')
         WHEN 'numeric_string' THEN 'prefix=''' || numeric_prefix || ''' suffix=''' || numeric_suffix || ''''
         WHEN 'date_string' THEN 'pattern: ' || date_format_hint
         WHEN 'free_text' THEN 'average length ' || CAST(round(avg_length) AS INTEGER)
         ELSE '' END AS detail,
       CASE name WHEN 'Paid' THEN 'whether the order was paid' WHEN 'level' THEN 'urgency' ELSE '' END AS description
FROM ({_profile('raw_orders')})"""

ORACLES["summary_lines"] = f"""
SELECT name, name || ' — ' || semantic_type || CASE WHEN detail <> '' THEN ': ' || detail ELSE '' END AS line
FROM ({ORACLES['profile_table']})"""

ORACLES["profile_with_approximate_counts"] = f"SELECT name, semantic_type FROM ({_profile('lineitem')})"

# Prose has long parts between its commas; as one value per document it is free text or, with copies, still long.
ORACLES["profile_with_prose_guard"] = f"""
SELECT name, CASE WHEN name = 'text' THEN 'free_text' ELSE semantic_type END AS semantic_type, n_unique
FROM ({_profile('documents')})"""

ORACLES["suggested_analyses"] = """
SELECT * FROM (VALUES
 (1, 'summary of the dataset and its column types', 'Order ID, Paid, Total Price, orderDate, tags, level, note, _c7'),
 (2, 'proportions of boolean and categorical columns', 'Paid, _c7'),
 (3, 'frequency of each tag', 'tags'),
 (4, 'distribution of ordinal columns in order', 'level')) AS v(rank, analysis, columns)"""

ORACLES["updated_view"] = """
SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS done, 'o_orderkey=key' AS notes FROM orders"""

ORACLES["detected_changes"] = """
SELECT * FROM (VALUES ('column_removed', 'o_orderstatus', 'string'), ('column_removed', 'o_totalprice', 'double'),
  ('column_removed', 'o_orderdate', 'timestamp_ntz'), ('column_removed', 'o_orderpriority', 'string'),
  ('column_added', 'note', 'string'), ('type_changed', 'o_orderkey', 'bigint -> string')) AS v(change, item, detail)
UNION ALL SELECT 'row_count', '', CAST(-count(*) AS VARCHAR) FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'"""


def _describe(source: str) -> str:
    parts = []
    for c, kind in _KINDS[source].items():
        if kind == "t":
            parts.append(f"""
SELECT '{c}' AS name, CAST(sum(n) AS BIGINT) AS "count", count(*) AS "unique", arg_max(v, (n, rn)) AS top, max(n) AS freq,
       CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS "min",
       CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75,
       CAST(NULL AS DOUBLE) AS "max"
FROM (SELECT v, n, row_number() OVER (ORDER BY v DESC) AS rn FROM (
      SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1))""")
            continue
        x = f"epoch_us({c}) / 1e6" if kind == "d" else f"CAST({c} AS DOUBLE)"
        std = "CAST(NULL AS DOUBLE)" if kind == "d" else "round(stddev_samp(x), 4)"
        parts.append(f"""
SELECT '{c}' AS name, count(x) AS "count", CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
       CAST(NULL AS BIGINT) AS freq, round(avg(x), 4) AS mean, {std} AS std, round(min(x), 4) AS "min",
       round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50,
       round(quantile_cont(x, 0.75), 4) AS p75, round(max(x), 4) AS "max"
FROM (SELECT {x} AS x FROM {source})""")
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


for _source in ("orders", "lineitem", "documents"):
    ORACLES[f"describe_{_source}"] = _describe(_source)

ORACLES["quality_report_raw_orders"] = f"""
WITH {RAW_ORDERS}, n AS (SELECT count(*) AS total FROM raw_orders),
found AS (
  SELECT '_c7' AS "column", 'unnamed_header' AS issue, total AS n FROM n
  UNION ALL SELECT unnest(['Order ID', 'Paid', 'Total Price', 'orderDate']), 'messy_header', total FROM n
  UNION ALL SELECT '_c7', 'empty_column', total FROM n
  UNION ALL SELECT 'Paid', 'missing_values', count(*) FILTER ("Paid" IS NULL) FROM raw_orders
  UNION ALL SELECT 'level', 'missing_values', count(*) FILTER (level IS NULL) FROM raw_orders
  UNION ALL SELECT 'Paid', 'untyped_boolean', count("Paid") FROM raw_orders
  UNION ALL SELECT 'orderDate', 'untyped_date', count("orderDate") FROM raw_orders
  UNION ALL SELECT 'Total Price', 'untyped_number', count("Total Price") FROM raw_orders
  UNION ALL SELECT 'tags', 'tags_in_cell', count(tags) FROM raw_orders
  UNION ALL SELECT 'level', 'unordered_scale', count(level) FROM raw_orders
  UNION ALL SELECT 'Order ID', 'high_cardinality', count(DISTINCT "Order ID") FROM raw_orders
  UNION ALL SELECT 'note', 'high_cardinality', count(DISTINCT note) FROM raw_orders)
SELECT "column", issue, found.n AS n, round(found.n / total, 9) AS ratio FROM found, n"""

# ---- engineering --------------------------------------------------------------------------------------------------

def _engineered(*others: str) -> str:
    return f"""
WITH {RAW_ORDERS}, p AS (SELECT *, CAST(coalesce(try_strptime("orderDate", '%m/%d/%Y'),
                                 try_strptime("orderDate", '%d/%m/%Y')) AS TIMESTAMP) AS day FROM raw_orders)
SELECT "Order ID" AS order_id, CASE WHEN "Paid" = 'Sim' THEN true WHEN "Paid" IS NOT NULL THEN false END AS paid,
       CAST(replace("Total Price", 'R$ ', '') AS DOUBLE) AS total_price, day AS order_date, tags,
       lower(trim(level)) AS level,
       CAST(list_position(['low', 'medium', 'high'], lower(trim(level))) - 1 AS INTEGER) AS level_rank,
       CAST(year(day) AS INTEGER) AS order_date_year, CAST(month(day) AS INTEGER) AS order_date_month,
       CAST(day(day) AS INTEGER) AS order_date_day, dayname(day) AS order_date_weekday,
       CAST(hour(day) AS INTEGER) AS order_date_hour, CAST(tags LIKE 'high,%' AS INTEGER) AS tags_high,
       CAST(tags LIKE 'low,%' AS INTEGER) AS tags_low, CAST(tags LIKE 'medium,%' AS INTEGER) AS tags_medium,
       CAST(tags LIKE 'not specified,%' AS INTEGER) AS tags_not_specified,
       CAST(tags LIKE '%plástico' AS INTEGER) AS tags_pl_stico, CAST(tags LIKE '%rede' AS INTEGER) AS tags_rede,
       CAST(tags LIKE 'urgent,%' AS INTEGER) AS tags_urgent, {", ".join(others)}
FROM p"""


ORACLES["engineer_raw_orders"] = _engineered("note", "_c7 AS column_8")
ORACLES["guided_features"] = _engineered("note")
ORACLES["guided_report"] = ORACLES["quality_report_raw_orders"]
_FEATURES = f"({ORACLES['guided_features']})"
ORACLES["guided_key_metrics"] = f"""
SELECT count(*) AS n_rows, count(total_price) AS total_price_count, round(sum(total_price), 4) AS total_price_sum,
       round(avg(total_price), 4) AS total_price_mean, round(min(total_price), 4) AS total_price_min,
       round(max(total_price), 4) AS total_price_max
FROM {_FEATURES}"""
ORACLES["guided_summary"] = f"""
SELECT paid, count(*) AS n_rows, count(total_price) AS total_price_count, round(avg(total_price), 6) AS total_price_mean,
       round(stddev_samp(total_price), 6) AS total_price_std, min(total_price) AS total_price_min,
       max(total_price) AS total_price_max
FROM {_FEATURES} GROUP BY paid"""
ORACLES["guided_box"] = _box(_FEATURES, "total_price", None)
ORACLES["guided_ordinal"] = ORACLES["ordinal_distribution_known_scale"]
ORACLES["guided_tags"] = f"""
WITH {RAW_ORDERS}, c AS (SELECT DISTINCT * FROM ({_cells('raw_orders', 'tags', ',', '"Order ID"')}))
SELECT tag, count(*) AS n FROM c GROUP BY tag"""

ORACLES["guided_distributions"] = f"""
WITH {RAW_ORDERS}, c AS (SELECT CASE WHEN "Paid" = 'Sim' THEN 'true' WHEN "Paid" IS NOT NULL THEN 'false' END AS paid
                         FROM raw_orders)
{_distribution('c', 'paid')}"""

ORACLES["guided_trend"] = f"""
WITH {RAW_ORDERS}
SELECT CAST(date_trunc('month', coalesce(try_strptime("orderDate", '%m/%d/%Y'), try_strptime("orderDate", '%d/%m/%Y')))
       AS TIMESTAMP) AS period, count(*) AS n FROM raw_orders GROUP BY 1"""

ORACLES["guided_tag_pairs"] = ORACLES["tag_cooccurrence_orders"]

# ---- sources ------------------------------------------------------------------------------------------------------

ORACLES["csv_round_trip"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority FROM orders"""
ORACLES["tsv_round_trip"] = """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"""
ORACLES["csv_header_over_two_rows"] = """
SELECT c_custkey AS customer_key, c_name AS customer_name, c_acctbal AS account_balance, c_mktsegment AS account_segment
FROM customer"""
ORACLES["json_round_trip"] = """
SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at, event_type, value FROM events"""
ORACLES["xml_round_trip"] = """
SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part"""


ORACLES["profile_values_raw_orders"] = f"""
WITH {RAW_ORDERS}
SELECT 'Paid' AS name, "Paid" AS value, count(*) AS n FROM raw_orders WHERE "Paid" IS NOT NULL GROUP BY 2
UNION ALL SELECT 'level', level, count(*) FROM raw_orders WHERE level IS NOT NULL GROUP BY 2
UNION ALL SELECT 'tags', tag, count(*) FROM (SELECT trim(unnest(string_split(tags, ','))) AS tag FROM raw_orders) GROUP BY 2"""

ORACLES["profile_values_documents"] = """
SELECT 'lang' AS name, lang AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'text', tag, count(*) FROM (
  SELECT unnest(list_distinct([trim(t, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) FOR t IN string_split(text, ',')]))
    AS tag FROM documents)
WHERE lower(tag) NOT IN ('', 'nan') GROUP BY 2"""

ORACLES["profile_embeddings"] = " UNION ALL ".join([
    f"SELECT * FROM ({_number_profile('embeddings', 'vec_id')})", f"SELECT * FROM ({_number_profile('embeddings', 'label')})",
    f"""SELECT * REPLACE ('unknown' AS semantic_type, NULL AS categories) FROM (
        {_number_profile("(SELECT hash(embedding) AS embedding FROM embeddings)", "embedding")})"""])

ORACLES["dataset_summary_lines"] = """
WITH o AS (SELECT count(*) AS n FROM orders),
columns AS (
  SELECT 0 AS i, 'o_orderkey' AS c, 'bigint' AS t, count(DISTINCT o_orderkey) AS d, ' — numeric' AS m FROM orders
  UNION ALL SELECT 1, 'o_custkey', 'bigint', count(DISTINCT o_custkey), ' — numeric' FROM orders
  UNION ALL SELECT 2, 'o_orderstatus', 'string', count(DISTINCT o_orderstatus), ' — categorical: '
    || count(DISTINCT o_orderstatus) || ' categories: ['
    || string_agg(DISTINCT chr(39) || o_orderstatus || chr(39), ', ' ORDER BY chr(39) || o_orderstatus || chr(39)) || ']' FROM orders
  UNION ALL SELECT 3, 'o_totalprice', 'double', count(DISTINCT o_totalprice), ' — numeric' FROM orders
  UNION ALL SELECT 4, 'o_orderdate', 'timestamp_ntz', count(DISTINCT o_orderdate), ' — datetime' FROM orders
  UNION ALL SELECT 5, 'o_orderpriority', 'string', count(DISTINCT o_orderpriority), ' — categorical: '
    || count(DISTINCT o_orderpriority) || ' categories: ['
    || string_agg(DISTINCT chr(39) || o_orderpriority || chr(39), ', ' ORDER BY chr(39) || o_orderpriority || chr(39)) || ']' FROM orders)
SELECT 0 AS place, n || ' rows x 6 columns' AS line FROM o
UNION ALL SELECT 1, '' UNION ALL SELECT 2, 'Columns:'
UNION ALL SELECT 3 + i, '  ' || c || ' (' || t || '): ' || n || ' filled, ' || d || ' distinct' FROM columns, o
UNION ALL SELECT 9, '' UNION ALL SELECT 10, 'Meaning:'
UNION ALL SELECT 11 + i, '  ' || c || m FROM columns"""

_WITH_NAN = """
priced AS (SELECT o_orderkey, o_orderpriority,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 100000) AS BIGINT) % 3 END AS price FROM orders)"""

ORACLES["encode_label_with_nan"] = f"""
WITH {_WITH_NAN}, codes AS (SELECT price, row_number() OVER (ORDER BY price) - 1 AS code
                            FROM (SELECT DISTINCT price FROM priced WHERE price IS NOT NULL))
SELECT o_orderkey, coalesce(code, -1) AS code FROM priced LEFT JOIN codes USING (price)"""

ORACLES["encode_frequency_with_nan"] = f"""
WITH {_WITH_NAN}, shares AS (SELECT price, count(*) / sum(count(*)) OVER () AS share
                             FROM priced WHERE price IS NOT NULL GROUP BY 1)
SELECT o_orderkey, round(share, 9) AS share FROM priced LEFT JOIN shares USING (price)"""

ORACLES["encode_onehot_with_nan"] = f"""
WITH {_WITH_NAN}
SELECT o_orderkey, """ + ", ".join(f"CAST(coalesce(price = {v}, false) AS INTEGER) AS p{v}" for v in range(3)) + " FROM priced"

ORACLES["distribution_with_nan"] = f"""
WITH {_WITH_NAN}
SELECT CAST(price AS DOUBLE) AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM priced WHERE price IS NOT NULL GROUP BY price"""

ORACLES["crosstab_with_nan"] = f"""
WITH {_WITH_NAN}
SELECT o_orderpriority, CAST(price AS DOUBLE) AS price, count(*) AS n FROM priced WHERE price IS NOT NULL GROUP BY 1, 2"""

ORACLES["share_with_nan"] = f"""
WITH {_WITH_NAN}
SELECT o_orderpriority AS "group", CAST(price AS DOUBLE) AS value, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 9) AS share
FROM priced WHERE price IS NOT NULL GROUP BY o_orderpriority, price"""

ORACLES["fill_mean_with_nan"] = f"""
WITH {_WITH_NAN}
SELECT o_orderkey, round(coalesce(CAST(price AS DOUBLE), avg(price) OVER ()), 6) AS price FROM priced"""

ORACLES["engineer_with_nan"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS flag FROM orders"""

ORACLES["encode_onehot_case"] = f"""
WITH {RAW_ORDERS}
SELECT "Order ID" AS order_id, """ + ", ".join(
    f"CAST(coalesce(level = '{v}', false) AS INTEGER) AS \"{n}\"" for v, n in (
        ("High", "is_High"), ("Medium", "is_Medium"), ("high", "is_high_2"), (" low ", "is_low"))) + " FROM raw_orders"

ORACLES["csv_round_trip_documents"] = "SELECT * FROM documents"

ORACLES["tsv_round_trip_documents"] = "SELECT * FROM documents"

ORACLES["xml_row_element_found"] = "SELECT c_custkey, c_name, c_mktsegment FROM customer"

ORACLES["json_array"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"

ORACLES["csv_one_file_documents"] = "SELECT * FROM documents"

ORACLES["csv_other_column_orders"] = """
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderpriority END AS o_orderpriority
FROM orders"""

ORACLES["csv_header_over_two_rows_documents"] = """
SELECT doc_id AS document_key, text AS document_text, lang AS where_from_language, source AS where_from_source,
  n_chars AS size_characters FROM documents"""

ORACLES["json_mixed_layouts"] = "SELECT * FROM documents"

# ---- frequent values, sparse indicators, patterns and changes -----------------------------------------------------

ORACLES["most_frequent_values"] = """
WITH c AS (
  SELECT 'customer' AS name, CAST(o_custkey AS VARCHAR) AS value FROM orders
  UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders
  UNION ALL SELECT 'total', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) FROM orders),
counted AS (SELECT name, value, count(*) AS n FROM c GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS INTEGER) AS rank FROM counted)
SELECT name, value, n, rank FROM ranked WHERE rank <= 5"""

_TEXT_TAGS = """tags AS (
  SELECT doc_id, unnest(list_distinct([trim(t, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))
    FOR t IN string_split(text, ',')])) AS value FROM documents),
held AS (SELECT * FROM tags WHERE lower(value) NOT IN ('', 'nan')),
counted AS (SELECT value, count(*) AS n FROM held GROUP BY value),
coded AS (SELECT value, n, row_number() OVER (ORDER BY value) - 1 AS code FROM counted)"""

ORACLES["profile_most_frequent_documents"] = f"""
WITH {_TEXT_TAGS},
ranked AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS place FROM counted)
SELECT 'text' AS name, (SELECT count(DISTINCT value) FROM tags WHERE value <> '') AS n_tags, CAST(place AS INTEGER) AS place, value
FROM ranked WHERE place < 12"""

ORACLES["engineer_documents"] = f"""
WITH {_TEXT_TAGS},
rows_ AS (SELECT doc_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY code) AS codes
          FROM held JOIN coded USING (value) GROUP BY doc_id)
SELECT doc_id, lang, source, n_chars, coalesce(codes, '') AS text_tags FROM documents LEFT JOIN rows_ USING (doc_id)"""

ORACLES["sparse_tag_sums_documents"] = f"WITH {_TEXT_TAGS} SELECT value, n FROM counted"

ORACLES["sparse_onehot_customers"] = """
SELECT o_orderkey, o_custkey, CAST(o_custkey = 1 AS INTEGER) AS is_1, CAST(o_custkey = 4 AS INTEGER) AS is_4, 0 AS is_none
FROM orders"""

_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_quantity * l_discount", "l_extendedprice * l_tax + l_quantity",
         "l_quantity * l_quantity", "l_extendedprice / l_quantity"]
_WIDE_NAMES = [f"{side}{i}" for side in "ab" for i in range(len(_WIDE))]
ORACLES["correlation_matrix_wide"] = "WITH items AS (SELECT " + ", ".join(
    [f"{c} AS a{i}" for i, c in enumerate(_WIDE)]
    + [f"CASE WHEN l_orderkey % {i + 2} <> 0 THEN {c} END AS b{i}" for i, c in enumerate(_WIDE)]) + " FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM items" for a in _WIDE_NAMES for b in _WIDE_NAMES)

ORACLES["tag_cooccurrence_frequent_documents"] = f"""
WITH {_TEXT_TAGS}, often AS (SELECT h.* FROM held h JOIN counted c ON h.value = c.value WHERE c.n >= 20)
SELECT a.value AS tag_a, b.value AS tag_b, count(*) AS n FROM often a JOIN often b ON a.doc_id = b.doc_id AND a.value < b.value
GROUP BY 1, 2 HAVING count(*) >= 20"""

ORACLES["missing_patterns"] = f"""
WITH {RAW_ORDERS}, m AS (
  SELECT concat_ws('+', """ + ", ".join(
    f"""CASE WHEN "{c}" IS NULL OR trim("{c}") = '' THEN '{c}' END""" for c in (
        "Order ID", "Paid", "Total Price", "orderDate", "tags", "level", "note", "_c7")) + """) AS columns FROM raw_orders)
SELECT columns, len(string_split(columns, '+')) * CAST(columns <> '' AS BIGINT) AS n_missing, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM m), 9) AS ratio FROM m GROUP BY columns"""

ORACLES["missing_together_planted"] = """
WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT columns, n, round(n / (SELECT count(*) FROM o), 9) AS ratio FROM (
  SELECT 'customer+price' AS columns, count(*) AS n FROM o WHERE k % 7 = 0
  UNION ALL SELECT 'customer+price+day+priority', count(*) FROM o WHERE k % 14 = 0
  UNION ALL SELECT 'customer+price+priority', count(*) FROM o WHERE k % 7 = 0 AND (k % 14 = 0 OR k % 5 = 0))"""

ORACLES["cell_changes_orders"] = """
WITH c AS (
  SELECT o_orderkey, unnest([
    {'column': 'o_custkey', 'before': CAST(o_custkey AS VARCHAR), 'after': CAST(o_custkey + CAST(o_orderkey % 97 = 0 AS INTEGER) AS VARCHAR)},
    {'column': 'o_orderstatus', 'before': o_orderstatus, 'after': CASE WHEN o_orderkey % 101 > 0 THEN o_orderstatus END},
    {'column': 'o_orderpriority', 'before': o_orderpriority, 'after': o_orderpriority}]) AS cell FROM orders)
SELECT o_orderkey, cell.column AS "column", 'changed' AS change, cell.before AS before, cell.after AS after FROM c
WHERE o_orderkey % 89 > 0 AND cell.before IS DISTINCT FROM cell.after
UNION ALL SELECT o_orderkey, cell.column, 'removed', cell.before, NULL FROM c WHERE o_orderkey % 89 = 0
UNION ALL SELECT o_orderkey + 100000000, cell.column, 'added', NULL, cell.before FROM c WHERE o_orderkey % 83 = 0"""

for _name in ("orders", "documents", "raw_orders"):
    ORACLES[f"profile_merged_{_name}"] = ORACLES[f"profile_{_name}"]
