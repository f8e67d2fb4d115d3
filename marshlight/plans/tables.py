"""The archive's tables derived from the given ones, row by row, so that every query grows with them.

``operations`` comes from orders (a row an order), ``shapes`` from customer (a rectangle a customer), ``observations``
from events. The SQL constants say the same for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.session import dealt


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, values: tuple) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _sql_pick(key: str, values: tuple[str, ...]) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][({key}) % {len(values)} + 1]"


PRODUCT_NAMES = tuple(name for _, name in K.PRODUCTS)
PERIODS = ("morning", "evening", "afternoon", "night")


def operations(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    """``costly``: more is done with a row than orders of it are read, so they are dealt."""
    o = load(spark, sf_dir, "orders")
    o = dealt(o, "o_orderkey") if costly else o
    k, mid = F.col("o_orderkey"), F.concat(F.lit("Z"), F.col("o_custkey"))
    date, stamp = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyyMMddHHmmss")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("postponed")
    return o.select(
        F.concat_ws("|", date, mid).alias("id"), date.alias("date"), F.when(k % 3 == 0, "aerial").otherwise("ground").alias("method"), F.when(k % 5 == 0, "larval").otherwise("adult").alias("target"),
        F.when(k % 7 == 0, F.array(_pick(k, PRODUCT_NAMES))).otherwise(F.array(_pick(k, PRODUCT_NAMES), _pick(k + 1, PRODUCT_NAMES))).alias("products"),
        F.when(k % 4 != 0, _pick(k, PERIODS)).alias("period"), F.concat(F.lit("Area "), F.col("o_custkey")).alias("area_name"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("boundary_text"),
        mid.alias("mid"), F.format_string(K.MAP_URL, mid).alias("map_url"), status.alias("status"), F.when(status != "scheduled", F.upper(status)).alias("status_text"),
        F.when(F.col("o_orderstatus") == "F", "past").otherwise("current").alias("section"), F.when(F.col("o_orderpriority") == "1-URGENT", "live").otherwise(F.concat(F.lit("wayback:"), stamp)).alias("source"),
        F.concat(date, F.lit("T00:00:00Z")).alias("first_seen"), F.lit(None).cast("string").alias("time_start"), F.lit(None).cast("string").alias("time_end"), k.alias("seq"),
    )


OPERATIONS_SQL = f"""ops AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || '|Z' || o_custkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'aerial' ELSE 'ground' END AS method, CASE WHEN o_orderkey % 5 = 0 THEN 'larval' ELSE 'adult' END AS target,
  CASE WHEN o_orderkey % 7 = 0 THEN [{_sql_pick('o_orderkey', PRODUCT_NAMES)}] ELSE [{_sql_pick('o_orderkey', PRODUCT_NAMES)}, {_sql_pick('o_orderkey + 1', PRODUCT_NAMES)}] END AS products,
  CASE WHEN o_orderkey % 4 <> 0 THEN {_sql_pick('o_orderkey', PERIODS)} END AS period, 'Area ' || o_custkey AS area_name,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS boundary_text, 'Z' || o_custkey AS mid, '{K.MAP_URL.replace('%s', '')}Z' || o_custkey AS map_url,
  CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'scheduled' ELSE 'postponed' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN NULL ELSE 'POSTPONED' END AS status_text,
  CASE WHEN o_orderstatus = 'F' THEN 'past' ELSE 'current' END AS section,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'live' ELSE 'wayback:' || strftime(o_orderdate, '%Y%m%d%H%M%S') END AS source,
  strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS first_seen, o_orderkey AS seq FROM orders)"""

ZONE_PREFIXES = ("D", "E", "L", "LN", "M", "MH", "R", "S", "SC", "T", "TH", "X")
ZONE_FORMS = ("%s%d(b)- Brack", "%s%d: west", "%s-%d Portion", "%s%d", "Untitled %s %d", "%s%d00-x")


def _corners(key: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, width and height of a customer's rectangle; one in 50 lies outside the area."""
    west = F.when(key % 50 == 7, 10.0).otherwise(-121.5 + (key % 97) / 200.0)
    return west, 37.5 + (key % 89) / 200.0, 0.01 + (key % 13) / 1000.0, 0.02 + (key % 11) / 1000.0


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer in 41 has no shape. Rectangles are closed and counter-clockwise; one in 10 has a hole, one in 9 a second part."""
    k = F.col("c_custkey")
    w, s, dx, dy = _corners(k)

    def ring(west: Column, south: Column, wide: Column, high: Column, clockwise: bool = False) -> Column:
        points = [(west, south), (west + wide, south), (west + wide, south + high), (west, south + high), (west, south)]
        return F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in (reversed(points) if clockwise else points)))

    first = F.when(k % 10 == 0, F.array(ring(w, s, dx, dy), ring(w + dx / 4, s + dy / 4, dx / 2, dy / 2, True))).otherwise(F.array(ring(w, s, dx, dy)))
    polygons = F.when(k % 9 == 0, F.array(first, F.array(ring(w, s + 2 * dy, dx, dy)))).otherwise(F.array(first))
    name = zone_name(k)
    return dealt(load(spark, sf_dir, "customer"), "c_custkey").filter(k % 41 != 40).select(F.concat(F.lit("Z"), k).alias("mid"), name.alias("doc_name"), polygons.alias("polygons"), k.alias("key"))


def zone_name(key: Column) -> Column:
    forms = F.array(*(F.format_string(f, _pick(key, ZONE_PREFIXES), (key % 99 + 1).cast("int")) for f in ZONE_FORMS))
    return F.get(forms, F.pmod(key, F.lit(len(ZONE_FORMS))).cast("int"))


SHAPES_SQL = f"""corners AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 7 THEN 10.0::DOUBLE ELSE -121.5 + (c_custkey % 97) / 200.0::DOUBLE END AS w,
  37.5 + (c_custkey % 89) / 200.0::DOUBLE AS s, 0.01 + (c_custkey % 13) / 1000.0::DOUBLE AS dx, 0.02 + (c_custkey % 11) / 1000.0::DOUBLE AS dy FROM customer WHERE c_custkey % 41 <> 40),
shapes AS (SELECT 'Z' || k AS mid, k AS key, w, s, dx, dy, printf([{', '.join(repr(f) for f in ZONE_FORMS)}][k % {len(ZONE_FORMS)} + 1], {_sql_pick('k', ZONE_PREFIXES)}, k % 99 + 1) AS doc_name FROM corners)"""

#: Area of a rectangle between parallels on the sphere; the spherical edge formula gives just this for it.
RECTANGLE_SQL = f"abs(radians({{dx}}) * (2 * (2 + sin(radians({{s}})) + sin(radians({{s}}))) - 2 * (2 + sin(radians({{s}} + {{dy}})) + sin(radians({{s}} + {{dy}})))) / 2) * {K.EARTH_RADIUS_KM} * {K.EARTH_RADIUS_KM} / 2"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of (day, user): purchases are live, clicks are captures, all else has no rank."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id")
    source = F.when(F.col("event_type") == "purchase", "live").when(F.col("event_type") == "click", F.concat(F.lit("wayback:"), F.date_format("ts", "yyyyMMddHHmmss"))).otherwise("other")
    return e.select(
        F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), F.col("user_id")).alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("user_id").cast("string").alias("mid"),
        F.col("event_type").alias("status"), F.when(k % 3 != 0, F.col("props")).alias("status_text"), F.when(k % 2 == 0, "current").otherwise("past").alias("section"), source.alias("source"),
        F.when(k % 4 != 0, F.col("props")).otherwise("").alias("area_name"), F.when(k % 5 == 0, F.col("event_type")).alias("method"), k.cast("string").alias("first_seen"), k.alias("seq"),
    )


OBSERVATIONS_SQL = """obs AS (SELECT strftime(ts, '%Y-%m-%d') || '|' || user_id AS id, strftime(ts, '%Y-%m-%d') AS date, user_id::VARCHAR AS mid, event_type AS status,
  CASE WHEN event_id % 3 <> 0 THEN props END AS status_text, CASE WHEN event_id % 2 = 0 THEN 'current' ELSE 'past' END AS section,
  CASE event_type WHEN 'purchase' THEN 'live' WHEN 'click' THEN 'wayback:' || strftime(ts, '%Y%m%d%H%M%S') ELSE 'other' END AS source,
  CASE WHEN event_id % 4 <> 0 THEN props ELSE '' END AS area_name, CASE WHEN event_id % 5 = 0 THEN event_type END AS method, event_id::VARCHAR AS first_seen, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS level, CASE WHEN event_type = 'click' THEN strftime(ts, '%Y%m%d%H%M%S') ELSE '' END AS stamp FROM events)"""

CAPTURE_STATUS = ("200", "200", "200", "301", "200")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures of a page: (ts, statuscode, digest, ord)."""
    e = load(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyyMMddHHmmss").alias("ts"), F.when(F.col("event_type") == "error", "404").otherwise("200").alias("statuscode"), F.concat(F.lit("d"), F.pmod("user_id", F.lit(40))).alias("digest"), F.col("event_id").alias("ord"))


#: The greedy rule as a recursive walk over days: of a day's captures in order the first whose digest is free.
CAPTURES_SQL = """cap AS (SELECT strftime(ts, '%Y%m%d%H%M%S') AS ts, CASE WHEN event_type = 'error' THEN '404' ELSE '200' END AS statuscode, 'd' || (user_id % 40) AS digest, event_id AS ord FROM events),
good AS (SELECT *, substr(ts, 1, 8) AS day, row_number() OVER (PARTITION BY substr(ts, 1, 8) ORDER BY ts, ord) AS nth FROM cap WHERE statuscode = '200' AND ts >= '{floor}'),
days AS (SELECT row_number() OVER (ORDER BY day) AS i, day, list({{'ts': ts, 'ord': ord, 'digest': digest}} ORDER BY ts, ord) AS rows FROM good GROUP BY day),
walk AS (SELECT 0::BIGINT AS i, NULL::STRUCT(ts VARCHAR, ord BIGINT, digest VARCHAR) AS pick, []::VARCHAR[] AS used
  UNION ALL SELECT d.i, list_filter(d.rows, lambda r: NOT list_contains(w.used, r.digest))[1],
    list_append(w.used, coalesce(list_filter(d.rows, lambda r: NOT list_contains(w.used, r.digest))[1].digest, '')) FROM walk w JOIN days d ON d.i = w.i + 1),
kept AS (SELECT pick.ts AS ts, pick.ord AS ord, pick.digest AS digest FROM walk WHERE pick IS NOT NULL)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header sentence for each order, with the fields that it was made from."""
    o = dealt(load(spark, sf_dir, "orders"), "o_orderkey")
    k = F.col("o_orderkey")
    hour, minute = F.pmod(k, F.lit(12)) + 1, F.lpad(F.pmod(k, F.lit(60)).cast("string"), 2, "0")
    half = F.when(k % 2 == 0, "a.m.").otherwise("p.m.")
    using = F.when(k % 6 == 5, "").otherwise(F.concat(F.lit(" using "), _pick(k, PRODUCT_NAMES), F.when(k % 3 == 0, "® and/or ").otherwise(" & "), _pick(k + 1, PRODUCT_NAMES)))
    tail = F.when(k % 8 == 1, " POSTPONED TO MONDAY, JULY 27, 2026").when(k % 8 == 2, " CANCELED.").when(k % 8 == 3, " COMPLETE").otherwise("")
    day = F.when(k % 9 == 4, "June 31, 2001 or ").otherwise("")
    text = F.concat(
        F.when(k % 3 == 0, "Aerial").otherwise("Ground"), F.lit(" spraying for "), F.when(k % 5 == 0, "larvae").otherwise("adult"), F.lit(" insect control"), using, F.lit(" is scheduled for the "),
        _pick(k, PERIODS), F.lit("  of Friday, "), day, F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(", between "), hour, F.lit(":"), minute, F.lit(" "), half, F.lit(" and 11:05 PM"), tail,
    )
    return o.select(k.alias("key"), text.alias("header"), "o_orderdate")


HEADERS_SQL = "keys AS (SELECT o_orderkey AS k, o_orderdate FROM orders)"
