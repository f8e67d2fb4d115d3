"""Every registered query of the archive's operators, with the SQL that it must equal."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.functions import geo
from marshlight.functions import text as X
from marshlight.operators import export, footprint, merge, quality, sink, timeline
from marshlight.plans import tables as T
from marshlight.session import parts_of, scratch_dir, spread, stored
from marshlight.sources import archive, captures, html, kml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TODAY = "2001-09-01"
OPS, SHAPES, OBS = T.OPERATIONS_SQL, T.SHAPES_SQL, T.OBSERVATIONS_SQL


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _pick_sql(key: str, values: tuple[str, ...]) -> str:
    return T._sql_pick(key, values)


def _texts(spark: SparkSession, sf_dir: str, column) -> DataFrame:  # noqa: ANN001
    return T.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), column)


# ---------------------------------------------------------------- timelines
@query("trail_window", "SELECT d::VARCHAR AS d, sum(n) OVER (ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)::BIGINT AS visible FROM (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1)")
def trail_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.trail(timeline.per_day(T.load(spark, sf_dir, "orders"), "o_orderdate"), 30).select(F.col("d").cast("string").alias("d"), "visible")


@query("cumulative", "SELECT d::VARCHAR AS d, sum(n) OVER (ORDER BY d)::BIGINT AS total FROM (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1)")
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.cumulative(timeline.per_day(T.load(spark, sf_dir, "orders"), "o_orderdate")).select(F.col("d").cast("string").alias("d"), "total")


_ISLANDS = """WITH c AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT *, d - row_number() OVER (ORDER BY d)::INTEGER AS k FROM c)
SELECT min(d)::VARCHAR AS first_day, max(d)::VARCHAR AS last_day, count(*) AS days, sum(n)::BIGINT AS n FROM g GROUP BY k"""


@query("islands", _ISLANDS)
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.islands(timeline.per_day(T.load(spark, sf_dir, "orders"), "o_orderdate"))
    return rows.select(F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "days", "n")


_CALENDAR = """WITH c AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest(range(min(d)::TIMESTAMP, max(d)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS d FROM c)
SELECT s.d::VARCHAR AS d, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN c USING (d)"""


@query("calendar_strip", _CALENDAR)
def calendar_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.calendar(timeline.per_day(T.load(spark, sf_dir, "orders"), "o_orderdate")).select(F.col("d").cast("string").alias("d"), "n")


@query("ops_per_year", f"WITH {OPS} SELECT substr(date, 1, 4)::INTEGER AS year, count(*) AS n FROM ops GROUP BY 1")
def ops_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.per_year(T.operations(spark, sf_dir), "date")


@query("ops_per_era", f"WITH {OBS} SELECT substr(date, 1, 4)::INTEGER AS year, CASE WHEN source = 'live' THEN 'live' WHEN source LIKE 'wayback:%' THEN 'captures of ' || substr(source, 9, 4) ELSE 'other' END AS era, count(*) AS n FROM obs GROUP BY 1, 2")
def ops_per_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.per_year_and_era(T.observations(spark, sf_dir), "date")


@query(
    "section_ffill",
    """SELECT event_id AS pos, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section
FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'past' WHEN 'signup' THEN 'current' END AS kind FROM events)""",
)
def section_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("event_type") == "purchase", "Past Scheduled Operations").when(F.col("event_type") == "signup", "Current operations").otherwise("Spray Alerts")
    rows = T.load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), X.section_kind(heading).alias("section"))
    return timeline.carry_forward(rows, ["user_id"], ["pos"], "section").select("pos", "section")


@query("section_kind", """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'past' WHEN 'signup' THEN 'current' END AS kind FROM events""")
def section_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("event_type") == "purchase", "Past Scheduled Operations").when(F.col("event_type") == "signup", "Current Scheduled Spray Operations").otherwise("Spray Alerts")
    return T.load(spark, sf_dir, "events").select("event_id", X.section_kind(heading).alias("kind"))


@query(
    "facet_counts",
    f"""WITH {OPS} SELECT 'method' AS facet, method AS value, count(*) AS n FROM ops GROUP BY 2 UNION ALL SELECT 'target', target, count(*) FROM ops GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM ops GROUP BY 2 UNION ALL SELECT 'product', p, count(*) FROM (SELECT unnest(products) AS p FROM ops) GROUP BY 2""",
)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = T.operations(spark, sf_dir).withColumnRenamed("products", "product")
    return timeline.facets(ops, ["method", "target", "status", "product"])


@query("filter_facets", f"WITH {OPS} SELECT id, seq FROM ops WHERE method = 'ground' AND target = 'adult' AND status = 'complete' AND list_contains(products, 'Dibrom')")
def filter_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = T.operations(spark, sf_dir)
    return ops.filter((F.col("method") == "ground") & (F.col("target") == "adult") & (F.col("status") == "complete") & F.array_contains("products", "Dibrom")).select("id", "seq")


@query("stats_treat_vs_zone", f"WITH {OPS} SELECT count(*) AS treatments, count(DISTINCT mid) AS zones FROM ops")
def stats_treat_vs_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.treatments_and_zones(T.operations(spark, sf_dir))


@query("stats_area_sums", "WITH x AS (SELECT o_custkey, max(o_totalprice) AS a, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT round(sum(a), 2) AS zone_area, round(sum(t), 2) AS treatment_area FROM x")
def stats_area_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = T.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mid"), F.col("o_totalprice").cast("decimal(20,2)").alias("area_sq_km"))
    return timeline.area_sums(ops).select(F.col("zone_area").cast("double").alias("zone_area"), F.col("treatment_area").cast("double").alias("treatment_area"))


@query("display_product", f"WITH {OPS} SELECT id, seq, list_filter({list(T.PRODUCT_NAMES)}, lambda p: list_contains(products, p))[1] AS product FROM ops")
def display_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.operations(spark, sf_dir).select("id", "seq", X.display_product(F.col("products")).alias("product"))


_DAYS = "count(DISTINCT date) AS days, min(date) AS date_min, max(date) AS date_max"


@query("summary_days", f"WITH {OPS} SELECT count(*) AS n, count(DISTINCT id) AS keys, {_DAYS} FROM ops")
def summary_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeline.summary(T.operations(spark, sf_dir), "id", "date")
    return s.select("n", "keys", "days", F.col("date_min").cast("string").alias("date_min"), F.col("date_max").cast("string").alias("date_max"))


@query(
    "summary_backfill",
    f"""WITH {OBS}, s AS (SELECT coalesce(source, '?') AS source, count(*) AS n FROM obs GROUP BY 1) SELECT count(*) AS operations, count(DISTINCT mid) AS unique_mids, count(DISTINCT date) AS unique_dates,
  min(date) AS date_min, max(date) AS date_max, (SELECT sha256(string_agg(source || '=' || n, ';' ORDER BY source)) FROM s) AS by_source FROM obs""",
)
def summary_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeline.backfill_summary(T.observations(spark, sf_dir))
    listed = F.array_join(F.transform("by_source", lambda x: F.concat(x["source"], F.lit("="), x["n"])), ";")
    return s.withColumn("by_source", F.sha2(listed, 256))


@query("summary_stage", f"WITH {OPS} SELECT (SELECT sum(length(html))::BIGINT FROM pages) AS html_bytes, (SELECT count(*) FROM ops) AS operations, (SELECT count(DISTINCT mid) FROM ops) AS unique_mids")
def summary_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.stage_summary(T.load(spark, sf_dir, "pages"), T.operations(spark, sf_dir))


@query(
    "summary_export",
    f"""WITH {OPS}, {SHAPES} SELECT count(*) AS operations, count(DISTINCT ops.mid) AS zones, min(date) AS date_min, max(date) AS date_max, count(shapes.mid) AS features,
  count(*) - count(shapes.mid) AS skipped FROM ops LEFT JOIN shapes ON ops.mid = shapes.mid""",
)
def summary_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marshlight.plans.pipeline import export_summary

    return export_summary(T.operations(spark, sf_dir), T.shapes(spark, sf_dir))


# ---------------------------------------------------------------- headers
def _header_query(name: str, sql: str, column: Callable) -> None:
    @query(name, f"WITH {T.HEADERS_SQL} SELECT k AS key, {sql} FROM keys")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = T.headers(spark, sf_dir).withColumn("header", X.clean(F.col("header")))
        return rows.select("key", *(c.alias(n) for n, c in column(F.col("header")).items()))


_P = T.PRODUCT_NAMES
_RAW_SQL = f"CASE WHEN k % 6 = 5 THEN '' ELSE {_pick_sql('k', _P)} || '; ' || {_pick_sql('k + 1', _P)} END"
_DATE_SQL = "strftime(o_orderdate, '%Y-%m-%d')"
_STATUS_SQL = "CASE k % 8 WHEN 1 THEN 'postponed' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'complete' ELSE 'scheduled' END"
_STATUS_TEXT_SQL = "CASE k % 8 WHEN 1 THEN 'POSTPONED TO MONDAY, JULY 27, 2026' WHEN 2 THEN 'CANCELED' WHEN 3 THEN 'COMPLETE' END"
_START_SQL = "lpad(((k % 12 + 1) % 12 + CASE WHEN k % 2 = 0 THEN 0 ELSE 12 END)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0')"
_METHOD_SQL, _TARGET_SQL = "CASE WHEN k % 3 = 0 THEN 'aerial' ELSE 'ground' END", "CASE WHEN k % 5 = 0 THEN 'larval' ELSE 'adult' END"
_header_query("hdr_method", f"{_METHOD_SQL} AS method", lambda h: {"method": X.method(h)})
_header_query("hdr_target", f"{_TARGET_SQL} AS target", lambda h: {"target": X.target(h)})
_header_query("hdr_period", f"{_pick_sql('k', T.PERIODS)} AS period", lambda h: {"period": X.period(h)})
_header_query("hdr_times", f"{_START_SQL} AS time_start, '23:05' AS time_end", lambda h: {"time_start": X.times(h)["time_start"], "time_end": X.times(h)["time_end"]})
_header_query("hdr_date", f"{_DATE_SQL} AS date, regexp_replace(strftime(o_orderdate, '%B %d, %Y'), ' 0', ' ') AS date_text", lambda h: {"date": F.date_format(X.first_date(h)["date"], "yyyy-MM-dd"), "date_text": X.first_date(h)["date_text"]})
_header_query("hdr_products", f"{_RAW_SQL} AS products_raw", lambda h: {"products_raw": F.array_join(X.products_raw(h), "; ")})
_header_query("canonical_product", f"{_RAW_SQL} AS products", lambda h: {"products": F.array_join(X.canonical_products(F.transform(X.products_raw(h), lambda p: F.concat(F.lower(p), F.lit(" ULV air")))), "; ")})
_header_query("status_normalize", f"{_STATUS_SQL} AS status, {_STATUS_TEXT_SQL} AS status_text", lambda h: {"status": X.status(h)["status"], "status_text": X.status(h)["status_text"]})
_header_query(
    "status_resolve_date", f"CASE WHEN k % 8 = 1 THEN '2026-07-27' ELSE {_DATE_SQL} END AS date",
    lambda h: {"date": F.date_format(X.resolve_date(X.first_date(h)["date"], X.status(h)["status"], X.status(h)["status_text"]), "yyyy-MM-dd")},
)
_header_query(
    "status_inherit", f"CASE WHEN k % 5 = 0 THEN 'cancelled' ELSE {_STATUS_SQL} END AS status, CASE WHEN k % 5 = 0 THEN 'CANCELLED' ELSE {_STATUS_TEXT_SQL} END AS status_text",
    lambda h: {n: X.inherit_status(X.status(F.when(F.col("key") % 5 == 0, "West block CANCELLED.")), X.status(h))[n] for n in ("status", "status_text")},
)


@query(
    "hdr_all", f"WITH {T.HEADERS_SQL} SELECT k AS key, {_METHOD_SQL} AS method, {_TARGET_SQL} AS target, {_pick_sql('k', T.PERIODS)} AS period, {_START_SQL} AS time_start, '23:05' AS time_end, {_RAW_SQL} AS products, {_DATE_SQL} AS date, {_STATUS_SQL} AS status FROM keys",
)
def hdr_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every header, each pattern run once a header: the structs are columns before their fields are taken."""
    rows = T.headers(spark, sf_dir).select("key", X.clean(F.col("header")).alias("header"))
    found = rows.select("key", *(c.alias(n) for n, c in X.header_fields(F.col("header")).items()))
    return found.select(
        "key", "method", "target", "period", "clock.time_start", "clock.time_end", F.array_join(X.canonical_products(F.col("products_raw")), "; ").alias("products"),
        F.date_format("first.date", "yyyy-MM-dd").alias("date"), "header_status.status",
    )


@query("hdr_all_sql", ORACLES["hdr_all"])
def hdr_all_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hdr_all`` as one SQL text over the registered functions."""
    from marshlight.functions import sql

    sql.register(spark)
    return spark.sql(
        """SELECT key, ml_header_method(h) AS method, ml_header_target(h) AS target, ml_header_period(h) AS period, clock.time_start, clock.time_end,
             array_join(ml_canonical_products(ml_products_raw(h)), '; ') AS products, date_format(first.date, 'yyyy-MM-dd') AS date, ml_status_of(h).status AS status
           FROM (SELECT key, h, ml_header_times(h) AS clock, ml_first_date(h) AS first FROM (SELECT key, ml_clean_text(header) AS h FROM {headers}))""",
        headers=T.headers(spark, sf_dir),
    )


# ---------------------------------------------------------------- other text
_CLEAN = """SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), chr(160) || chr(8217) || chr(8203), ' '''), '[\\s\\x0b\\x1c-\\x1f\\x85\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS text FROM documents"""


@query("clean_text", _CLEAN)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(T.load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.clean(F.col("text")).alias("text"))


@query("extract_param", "SELECT page_id, nullif(regexp_extract(url || CASE WHEN page_id % 3 = 0 THEN '&mid=1a_B-' || page_id ELSE '' END, '[?&]mid=([A-Za-z0-9_\\-]+)', 1), '') AS mid FROM pages")
def extract_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.load(spark, sf_dir, "pages")
    href = F.concat("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("&mid=1a_B-"), F.col("page_id"))).otherwise(""))
    return pages.select("page_id", X.mid_of_href(href).alias("mid"))


@query(
    "boundary_normalize",
    """SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN 'North to Road ' || o_custkey || ' St., South to French Camp Rd.' WHEN 1 THEN 'East to Lane ' || o_custkey || ' Rd.'
WHEN 2 THEN NULL ELSE 'Free prose ' || o_custkey END AS boundary_text FROM orders""",
)
def boundary_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit(">North to Road "), n, F.lit(" St., >S to French Camp Rd..")))
        .when(k % 4 == 1, F.concat(F.lit(": > E to  Lane "), n, F.lit(" Rd..")))
        .when(k % 4 == 2, F.lit("(rescheduled from Thursday, July 9, 2026)"))
        .otherwise(F.concat(F.lit("Free prose "), n))
    )
    return _texts(spark, sf_dir, X.boundary(text).alias("boundary_text"))


@query("area_fallback_name", "SELECT o_orderkey AS key, 'Area ' || o_custkey AS name FROM orders")
def area_fallback_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.concat(F.lit("Area "), F.col("o_custkey"))
    return _texts(spark, sf_dir, X.fallback_name(F.when(k % 3 == 0, F.concat(n, F.lit(": west > x"))).when(k % 3 == 1, F.concat(n, F.lit(">North"))).otherwise(n)).alias("name"))


_ZONE_SQL = "nullif(regexp_extract(doc_name, '^\\s*([A-Z]{1,3}-?\\d{1,3}[A-Za-z]?(?:\\([A-Za-z0-9]\\))?)(?:$|[\\s:,.\\-_])', 1), '')"
_REGION_SQL = "CASE regexp_extract(coalesce({z}, ''), '^[A-Z]+') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.REGIONS.items()) + " ELSE 'Unknown' END"


@query("zone_code", f"WITH {SHAPES} SELECT mid, {_ZONE_SQL} AS zone_code FROM shapes")
def zone_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shapes(spark, sf_dir).select("mid", X.zone_code(F.col("doc_name")).alias("zone_code"))


@query("zone_rederive", f"WITH {SHAPES} SELECT mid, coalesce({_ZONE_SQL}, 'D' || key) AS zone_code FROM shapes")
def zone_rederive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kml.rederive_zones(T.shapes(spark, sf_dir).withColumn("zone_code", F.concat(F.lit("D"), F.col("key")))).select("mid", "zone_code")


@query("region_of", f"WITH {SHAPES} SELECT mid, {_REGION_SQL.format(z=_ZONE_SQL)} AS region FROM shapes")
def region_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shapes(spark, sf_dir).select("mid", X.region(X.zone_code(F.col("doc_name"))).alias("region"))


@query("mid_correction", f"SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN '{list(K.MISLINKED.values())[0]}' ELSE 'Z' || o_custkey END AS mid FROM orders")
def mid_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = F.when(F.col("o_orderkey") % 10 == 0, F.lit(list(K.MISLINKED)[0])).otherwise(F.concat(F.lit("Z"), F.col("o_custkey")))
    return _texts(spark, sf_dir, X.corrected_mid(mid).alias("mid"))


@query("obs_rank", f"WITH {OBS} SELECT seq, level, stamp FROM obs")
def obs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = X.observation_rank(F.col("source"))
    return T.observations(spark, sf_dir).select("seq", rank["level"].alias("level"), rank["stamp"].alias("stamp"))


@query("since_pad", "SELECT o_orderkey AS key, rpad(CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y%m%d') END, 14, '0') AS since FROM orders")
def since_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _texts(spark, sf_dir, X.since_floor(text).alias("since"))


@query("url_template", f"SELECT o_orderkey AS key, '{K.MAP_URL.replace('%s', '')}Z' || o_custkey AS map_url, '{K.KML_URL.split('%s')[0]}Z' || o_custkey || '{K.KML_URL.split('%s')[1]}' AS kml_url, "
       f"'{K.SNAPSHOT_URL.split('%s')[0]}' || strftime(o_orderdate, '%Y%m%d%H%M%S') || 'id_/http://example.com/a' AS snapshot_url FROM orders")  # fmt: skip
def url_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = F.concat(F.lit("Z"), F.col("o_custkey"))
    rows = T.load(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("key"), archive.map_url(mid).alias("map_url"), archive.kml_url(mid).alias("kml_url"), archive.snapshot_url(F.date_format("o_orderdate", "yyyyMMddHHmmss"), "http://example.com/a").alias("snapshot_url"))


# ---------------------------------------------------------------- merges
_MERGED_COLUMNS = ["id", "status", "status_text", "section", "source", "area_name", "method", "date", "mid", "first_seen", "existed"]
_MERGE_SQL = f"""{OBS}, old AS (SELECT * FROM obs WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
every AS (SELECT *, true AS existed, seq AS s FROM old UNION ALL SELECT *, false, seq + 1000000000 FROM obs WHERE seq % 2 = 1)"""
_MERGED_SQL = f"""WITH {_MERGE_SQL} SELECT id, arg_max(status, (level, stamp, s)) AS status, arg_max({{'t': status_text}}, (level, stamp, s)).t AS status_text,
  arg_max(section, (level, stamp, s)) AS section, arg_max(source, (level, stamp, s)) AS source,
  coalesce(arg_max(area_name, s) FILTER (WHERE area_name <> ''), arg_min({{'t': area_name}}, s).t) AS area_name,
  coalesce(arg_max(method, s) FILTER (WHERE method <> ''), arg_min({{'t': method}}, s).t) AS method,
  arg_min(date, s) AS date, arg_min(mid, s) AS mid, arg_min(first_seen, s) AS first_seen, bool_or(existed) AS existed FROM every GROUP BY id"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even events are the archive, odd ones arrive: (existing, incoming) with the arrivals' seq above all others."""
    obs = T.observations(spark, sf_dir)
    return obs.filter("seq % 2 = 0"), obs.filter("seq % 2 = 1").withColumn("seq", F.col("seq") + 1_000_000_000)


@query("merge_append_only", _MERGED_SQL)
def merge_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_append_only(*_two(spark, sf_dir)).select(_MERGED_COLUMNS)


@query("merge_new_count", f"WITH {_MERGE_SQL} SELECT count(*) FILTER (WHERE NOT e) AS n_new FROM (SELECT bool_or(existed) AS e FROM every GROUP BY id)")
def merge_new_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.new_count(merge.merge_append_only(*_two(spark, sf_dir)))


@query(
    "merge_normalize",
    f"""WITH {OBS} SELECT * FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN id WHEN seq % 7 <> 0 THEN id END AS id, CASE WHEN seq % 5 = 0 THEN '2024-02-01T00:00:00Z' ELSE first_seen END AS first_seen FROM obs) WHERE id IS NOT NULL""",
)
def merge_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    obs = T.observations(spark, sf_dir).withColumns({"id": F.when(s % 3 == 0, F.col("id")).otherwise(""), "mid": F.when((s % 3 != 0) & (s % 7 == 0), "").otherwise(F.col("mid")), "first_seen": F.when(s % 5 == 0, None).otherwise(F.col("first_seen"))})
    return merge.normalize(obs, F.lit("2024-02-01T00:00:00Z")).select("seq", "id", "first_seen")


@query(
    "backfill_fold",
    f"""WITH {OBS} SELECT id, arg_max(status, seq) AS status, arg_max({{'t': status_text}}, seq).t AS status_text, arg_max(section, seq) AS section, arg_min(source, seq) AS source,
  arg_min(first_seen, seq) AS first_seen, coalesce(arg_min(area_name, seq) FILTER (WHERE area_name <> ''), arg_min(area_name, seq)) AS area_name, arg_min(method, seq) FILTER (WHERE method <> '') AS method FROM obs GROUP BY id""",
)
def backfill_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.backfill_fold(T.observations(spark, sf_dir)).select("id", "status", "status_text", "section", "source", "first_seen", "area_name", "method")


_OVERLAY = f"WITH {OBS} SELECT mid, arg_max(seq, (seq % 2, seq)) AS seq FROM obs GROUP BY mid"


@query("setop_overlay", _OVERLAY)
def setop_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: merge.last_by_key(T.observations(spark, sf_dir).filter(F.col("seq") % 2 == k).select("mid", "seq"), "mid", "seq")
    return merge.overlay(side(0), side(1), "mid")


@query("stream_merge", _MERGED_SQL.replace("seq % 2 = 0", "seq < 0").replace("WHERE seq % 2 = 1", ""))
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files into a stored archive, in one batch, and the archive's newest version."""
    from marshlight.streaming.merge import newest, stream_merge

    folder, store, state = (scratch_dir(spark, n) for n in ("stream-in", "stream-store", "stream-state"))
    T.observations(spark, sf_dir).write.parquet(folder)
    stream_merge(spark, folder, spark.read.parquet(folder).schema, store, state, lambda rows: rows, files_per_batch=1_000_000)
    return newest(spark, store).select(*_MERGED_COLUMNS[:-1]).withColumn("existed", F.lit(False))


_HAS_STATUS, _HAS_TEXT = "seq % 7 <> 0", "seq % 5 <> 0"
_MERGE_KEYS = f"""WITH {OBS}, old AS (SELECT * FROM obs WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
every AS (SELECT *, true AS existed, seq AS s FROM old UNION ALL SELECT *, false, seq + 1000000000 FROM obs WHERE seq % 2 = 1),
r AS (SELECT *, level::VARCHAR || stamp AS k, max(level::VARCHAR || stamp) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM every),
u AS (SELECT *, before IS NULL OR k >= before AS counts FROM r)
SELECT id, (arg_max({{'t': status}}, s) FILTER (WHERE counts AND {_HAS_STATUS})).t AS status, (arg_max({{'t': status_text}}, s) FILTER (WHERE counts AND {_HAS_TEXT})).t AS status_text,
  arg_max(section, s) FILTER (WHERE counts) AS section, arg_max(source, s) FILTER (WHERE counts) AS source, arg_min(date, s) AS date,
  arg_min(CASE WHEN seq % 3 <> 0 THEN '{{"crew":"' || mid || '","visits":[' || seq || ',null]}}' ELSE '' END, s) AS more,
  concat_ws(',', 'section', CASE WHEN bool_or(counts AND {_HAS_STATUS}) THEN 'status' END, CASE WHEN bool_or(counts AND {_HAS_TEXT}) THEN 'status_text' END) AS present FROM u GROUP BY id"""


@query("merge_unknown_keys", _MERGE_KEYS)
def merge_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as JSON elements, two thirds with keys outside the contract, some without status or status_text; read, merged, written as a document and read again."""
    s = F.col("seq")
    part = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f'"{name}":'), F.coalesce(F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))))
    fields = [part(c, F.col(c)) for c in ("id", "date", "mid", "section", "source")]
    fields += [part("status", F.col("status"), s % 7 != 0), part("status_text", F.col("status_text"), s % 5 != 0), part("crew", F.col("mid"), s % 3 != 0), part("visits", F.array(s, F.lit(None)), s % 3 != 0)]
    items = T.observations(spark, sf_dir).select(s.alias("seq"), F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}")).alias("item"))
    read = archive.operations_of_items(items, "seq").select("id", "date", "mid", "section", "source", "status", "status_text", "more", "present", "seq")
    merged = merge.merge_append_only(read.filter("seq % 2 = 0"), read.filter("seq % 2 = 1").withColumn("seq", F.col("seq") + 1_000_000_000))
    path = scratch_dir(spark, "unknown-keys")
    export.write_operations(merged, path, "t")
    found = archive.load_operations(spark, path)
    return found.select("id", "status", "status_text", "section", "source", "date", F.coalesce(F.to_json("more"), F.lit("")).alias("more"), F.array_join(F.sort_array("present"), ",").alias("present"))


_FOLDED = ["id", "status", "status_text", "section", "source", "first_seen", "area_name", "method"]


@query("stream_fold", ORACLES["backfill_fold"])
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in files out of their order, folded by a stream of three batches with state between them. A batch has as many files as its
    size asks for, so no task writes or reads a whole batch."""
    from marshlight.streaming import merge as streaming

    folder, store, state = (scratch_dir(spark, n) for n in ("fold-in", "fold-store", "fold-state"))
    obs = T.observations(spark, sf_dir)
    files = -(-parts_of(T.load(spark, sf_dir, "events")) // 3)
    obs.repartition(3 * files, F.xxhash64("seq")).write.parquet(folder)
    streaming.stream_fold(spark, folder, obs.schema, store, state, lambda rows: rows, files_per_batch=files)
    return streaming.newest(spark, store).select(*_FOLDED)


_BAD = "seq % 11 = 0 OR status = 'error'"


@query("stream_rejects", f"WITH {OBS} SELECT seq, id, CASE WHEN status = 'error' THEN 'status' ELSE 'number' END AS reason, 0::BIGINT AS batch FROM obs WHERE {_BAD}")
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one batch; observations that are bad go to the error table of the store."""
    from marshlight.streaming import merge as streaming

    folder, store, state = (scratch_dir(spark, n) for n in ("rejects-in", "rejects-store", "rejects-state"))
    T.observations(spark, sf_dir).write.parquet(folder)
    reason = F.when(F.col("status") == "error", "status").when(F.col("seq") % 11 == 0, "number")
    streaming.stream_merge(spark, folder, spark.read.parquet(folder).schema, store, state, lambda rows: rows, files_per_batch=1_000_000, reason=reason)
    return streaming.rejects(spark, store).select("seq", "id", "reason", "batch")


@query("captures_distinct", "SELECT DISTINCT strftime(ts, '%Y%m%d%H%M%S') AS ts FROM events")
def captures_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.distinct_captures(T.captures(spark, sf_dir))


@query("capture_dedupe", "WITH RECURSIVE " + T.CAPTURES_SQL.format(floor="20240103000000") + " SELECT ts, ord, digest FROM kept")
def capture_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.capture_reasons(T.captures(spark, sf_dir), merge.capture_floor(F.lit("2024-01-03")))
    return rows.filter("reason = 'kept'").select("ts", "ord", "digest")


_REASONS = """, r AS (SELECT CASE WHEN cap.statuscode <> '200' THEN 'status' WHEN cap.ts < '20240103000000' THEN 'floor' WHEN k.ord = cap.ord THEN 'kept' WHEN (k.ts, k.ord) < (cap.ts, cap.ord) THEN 'same_day' ELSE 'digest' END AS reason
  FROM cap LEFT JOIN kept k ON substr(k.ts, 1, 8) = substr(cap.ts, 1, 8)) SELECT reason, count(*) AS n FROM r GROUP BY 1"""


@query("capture_drop_counts", "WITH RECURSIVE " + T.CAPTURES_SQL.format(floor="20240103000000") + _REASONS)
def capture_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.capture_reasons(T.captures(spark, sf_dir), merge.capture_floor(F.lit("2024-01-03")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("latest_n", "WITH RECURSIVE " + T.CAPTURES_SQL.format(floor="20200814043508") + " SELECT ts, ord, digest FROM kept ORDER BY ts DESC, ord DESC LIMIT 5")
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.capture_reasons(T.captures(spark, sf_dir), merge.capture_floor(F.lit(None).cast("string")))
    return merge.latest_n(rows.filter("reason = 'kept'").select("ts", "ord", "digest"), 5)


@query("src_capture_table", "SELECT user_id, strftime(ts, '%Y%m%d%H%M%S') AS ts, '200' AS statuscode, 'd' || event_id AS digest FROM events")
def src_capture_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture listing for each event, columns in another order, read back."""
    listing = F.to_json(F.array(F.array(F.lit("digest"), F.lit("timestamp"), F.lit("statuscode")), F.array(F.concat(F.lit("d"), F.col("event_id")), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("200"))))
    rows = T.load(spark, sf_dir, "events").select("user_id", F.inline(archive.capture_table(listing)))
    return rows.select("user_id", "ts", "statuscode", "digest")


# ---------------------------------------------------------------- joins and sets
_LINES = "SELECT DISTINCT l_orderkey AS k FROM lineitem"


@query("join_left_shape", f"WITH {OPS}, {SHAPES} SELECT ops.seq, ops.id, shapes.doc_name FROM ops LEFT JOIN shapes USING (mid)")
def join_left_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.operations(spark, sf_dir).join(T.shapes(spark, sf_dir).select("mid", "doc_name"), "mid", "left").select("seq", "id", "doc_name")


@query("join_inner_shape", f"WITH {OPS}, {SHAPES} SELECT ops.seq, ops.id, shapes.doc_name FROM ops JOIN shapes USING (mid)")
def join_inner_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.operations(spark, sf_dir).join(T.shapes(spark, sf_dir).filter("polygons is not null").select("mid", "doc_name"), "mid").select("seq", "id", "doc_name")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return T.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mid")), T.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mid"))


@query("join_anti_missing", "SELECT o_orderkey AS mid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _keys(spark, sf_dir)
    return orders.join(lines, "mid", "left_anti")


@query("fk_unresolved", "SELECT DISTINCT o_orderkey::VARCHAR AS mid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 100 <> 0")
def fk_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (k.select(F.col("mid").cast("string").alias("mid")) for k in _keys(spark, sf_dir))
    return quality.unresolved(orders, lines, orders.filter("cast(mid as long) % 100 = 0"))


@query("fk_stale", f"SELECT o_orderkey AS mid FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey IN ({_LINES})")
def fk_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _keys(spark, sf_dir)
    return orders.filter("mid % 100 = 0").join(lines, "mid", "left_semi")


@query("fk_orphans", f"WITH {OPS}, {SHAPES} SELECT mid FROM shapes WHERE mid NOT IN (SELECT mid FROM ops WHERE status = 'complete' AND method = 'aerial')")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = T.operations(spark, sf_dir).filter("status = 'complete' and method = 'aerial'")
    return T.shapes(spark, sf_dir).select("mid").join(ops, "mid", "left_anti")


@query("fk_expected_missing", f"WITH {OPS}, {SHAPES} SELECT count(*) AS n_ops, count(DISTINCT mid) AS n_maps FROM ops WHERE mid NOT IN (SELECT mid FROM shapes)")
def fk_expected_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = T.load(spark, sf_dir, "customer").filter("c_custkey % 41 = 40").select(F.concat(F.lit("Z"), F.col("c_custkey")).alias("mid"))
    return T.operations(spark, sf_dir).join(known, "mid", "left_semi").agg(F.count(F.lit(1)).alias("n_ops"), F.count_distinct("mid").alias("n_maps"))


@query("mids_distinct", f"WITH {OPS} SELECT mid, min(seq) AS seq FROM ops WHERE mid <> '' GROUP BY mid")
def mids_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.operations(spark, sf_dir).filter("mid <> ''").groupBy("mid").agg(F.min("seq").alias("seq"))


@query("setop_union", "SELECT o_orderkey AS mid FROM orders UNION ALL SELECT l_orderkey FROM lineitem")
def setop_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _keys(spark, sf_dir)
    return orders.unionByName(lines)


@query("setop_except", "SELECT o_orderkey AS mid FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def setop_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _keys(spark, sf_dir)
    return orders.subtract(lines)


@query("setop_intersect", "SELECT o_orderkey AS mid FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def setop_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _keys(spark, sf_dir)
    return orders.intersect(lines)


for _name, _order in (("sort_ops", "date, id"), ("sort_backfill", "date, area_name, mid"), ("sort_export", "date, area_name, id")):

    @query(_name, f"WITH {OPS} SELECT id, seq FROM ops ORDER BY {_order}")
    def _sorted(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        ops = T.operations(spark, sf_dir)
        by = {"sort_ops": archive.sorted_operations, "sort_backfill": archive.sorted_backfill, "sort_export": lambda o: o.orderBy("date", F.coalesce("area_name", F.lit("")), "id")}
        return by[name](ops).select("id", "seq")


# ---------------------------------------------------------------- quality gate
@query("chk_dup_ids", f"WITH {OPS} SELECT id, count(*) AS n FROM ops GROUP BY id HAVING count(*) > 1")
def chk_dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(T.operations(spark, sf_dir), "id")


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with errors planted by key."""
    s = F.col("seq")
    return T.operations(spark, sf_dir).withColumns(
        {
            "area_name": F.when(s % 101 == 0, "").otherwise(F.col("area_name")), "section": F.when(s % 103 == 0, None).otherwise(F.col("section")),
            "method": F.when(s % 107 == 0, "boat").otherwise(F.col("method")), "id": F.when(s % 109 == 0, "x").otherwise(F.col("id")),
            "date": F.when(s % 113 == 0, "2001-06-31").when(s % 127 == 0, "1/2/2001").when(s % 131 == 0, "2031-01-01").otherwise(F.col("date")),
            "products": F.when(s % 137 == 0, F.array(F.lit("July 12"), F.lit("Dibrom"))).otherwise(F.col("products")),
        }
    )


_SPOILED = f"""{OPS}, bad AS (SELECT * REPLACE (CASE WHEN seq % 101 = 0 THEN '' ELSE area_name END AS area_name, CASE WHEN seq % 103 = 0 THEN NULL ELSE section END AS section,
  CASE WHEN seq % 107 = 0 THEN 'boat' ELSE method END AS method, CASE WHEN seq % 109 = 0 THEN 'x' ELSE id END AS id,
  CASE WHEN seq % 113 = 0 THEN '2001-06-31' WHEN seq % 127 = 0 THEN '1/2/2001' WHEN seq % 131 = 0 THEN '2031-01-01' ELSE date END AS date,
  CASE WHEN seq % 137 = 0 THEN ['July 12', 'Dibrom'] ELSE products END AS products) FROM ops)"""
_BAD_DATE = f"NOT coalesce(regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_cast(date AS DATE) BETWEEN DATE '{K.EARLIEST_DATE}' - INTERVAL 30 YEAR AND DATE '{TODAY}' + INTERVAL 60 DAY, false)"


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.operation_checks(_spoiled(spark, sf_dir), F.lit(TODAY).cast("date"))


_MISSING = " UNION ALL ".join(f"SELECT 'missing {f}' AS name, count(*) FILTER (WHERE coalesce({f}, '') = '') AS n_bad FROM bad" for f in K.REQUIRED)


@query("chk_missing", f"WITH {_SPOILED} {_MISSING}")
def chk_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).filter(F.col("name").startswith("missing "))


@query("chk_id", f"WITH {_SPOILED} SELECT 'id is not date|mid' AS name, count(*) FILTER (WHERE id <> date || '|' || mid) AS n_bad FROM bad")
def chk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).filter("name = 'id is not date|mid'")


@query("chk_date", f"WITH {_SPOILED} SELECT seq FROM bad WHERE NOT coalesce(regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_cast(date AS DATE) BETWEEN DATE '{K.EARLIEST_DATE}' AND DATE '{TODAY}' + INTERVAL 60 DAY, false)")
def chk_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoiled(spark, sf_dir).filter(quality.bad_date(F.col("date"), F.lit(TODAY).cast("date"))).select("seq")


_ENUMS = " UNION ALL ".join(f"SELECT '{f} outside its vocabulary' AS name, count(*) FILTER (WHERE NOT coalesce({f} IN {a}, false)) AS n_bad FROM bad" for f, a in (("method", K.METHODS), ("target", K.TARGETS), ("status", K.STATUSES), ("section", K.SECTIONS)))


@query("chk_enum", f"WITH {_SPOILED} {_ENUMS}")
def chk_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).filter(F.col("name").endswith("outside its vocabulary"))


@query("chk_products", f"WITH {_SPOILED} SELECT p AS product, count(*) AS n FROM (SELECT unnest(products) AS p FROM bad) WHERE p NOT IN {T.PRODUCT_NAMES} GROUP BY 1")
def chk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bad_products(_spoiled(spark, sf_dir))


@query("chk_samples", f"WITH {_SPOILED} SELECT method AS \"check\", array_to_string(list_sort(list(DISTINCT mid))[1:5], ',') AS sample FROM bad GROUP BY 1")
def chk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.samples(_spoiled(spark, sf_dir), F.col("method"), F.col("mid"), 5).select("check", F.array_join("sample", ",").alias("sample"))


@query("chk_verdict", f"WITH {OPS}, dup AS (SELECT count(*) AS n FROM (SELECT id FROM ops GROUP BY id HAVING count(*) > 1)), old AS (SELECT count(*) AS n FROM ops WHERE date < '{K.EARLIEST_DATE}') "
       "SELECT (dup.n = 0 AND old.n = 0) AS ok, ((dup.n > 0)::INT + (old.n > 0)::INT)::BIGINT AS n_failed FROM dup, old")  # fmt: skip
def chk_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdict(quality.operation_checks(T.operations(spark, sf_dir), F.lit(TODAY).cast("date")))


def _bad_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes with open rings (key modulo 23), rings of three points (29) and lines instead of areas (31)."""
    k = F.col("key")
    cut = lambda n: F.transform("polygons", lambda p: F.transform(p, lambda r: F.slice(r, 1, n)))
    shapes = T.shapes(spark, sf_dir).withColumn("geom_type", F.when(k % 31 == 0, "LineString").otherwise(geo.geometry_type(F.col("polygons"))))
    return shapes.withColumn("polygons", F.when(k % 23 == 0, cut(4)).when(k % 29 == 0, cut(3)).otherwise(F.col("polygons")))


_RINGS = "(1 + (key % 10 = 0)::INT + (key % 9 = 0)::INT)"
_GEOMETRY = f"""WITH {SHAPES} SELECT 'geometry type' AS name, count(*) FILTER (WHERE key % 31 = 0) AS n_bad FROM shapes
UNION ALL SELECT 'unclosed rings', sum(CASE WHEN key % 31 <> 0 AND (key % 23 = 0 OR key % 29 = 0) THEN {_RINGS} ELSE 0 END)::BIGINT FROM shapes
UNION ALL SELECT 'rings under 4 points', sum(CASE WHEN key % 31 <> 0 AND key % 23 <> 0 AND key % 29 = 0 THEN {_RINGS} ELSE 0 END)::BIGINT FROM shapes
UNION ALL SELECT 'rings out of bounds', sum(CASE WHEN key % 31 <> 0 AND key % 50 = 7 THEN {_RINGS} ELSE 0 END)::BIGINT FROM shapes"""


@query("chk_geometry", _GEOMETRY)
def chk_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.shape_checks(_bad_shapes(spark, sf_dir)).filter(~F.col("name").isin("no features", "duplicate shapes"))


@query("chk_dup_shapes", "SELECT count(*) - count(DISTINCT nullif(CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_custkey::VARCHAR END, '')) AS n_bad FROM orders")
def chk_dup_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = F.when(F.col("o_orderkey") % 17 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    return T.load(spark, sf_dir, "orders").select(mid.alias("mid")).agg(quality.duplicate_shapes().alias("n_bad"))


@query("area_stats", "WITH a AS (SELECT list_sort(list(o_totalprice)) AS v FROM orders WHERE o_totalprice <> 0) SELECT v[1] AS area_min, v[len(v) // 2 + 1] AS area_median, v[-1] AS area_max FROM a")
def area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.area_stats(T.load(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("area_sq_km")))


# ---------------------------------------------------------------- geometry
_R = T.RECTANGLE_SQL
_AREA = f"round(greatest({_R.format(s='s', dx='dx', dy='dy')} - CASE WHEN key % 10 = 0 THEN {_R.format(s='(s + dy / 4)', dx='(dx / 2)', dy='(dy / 2)')} ELSE 0 END, 0) + CASE WHEN key % 9 = 0 THEN {_R.format(s='(s + 2 * dy)', dx='dx', dy='dy')} ELSE 0 END, 4)"


@query("geo_area", f"WITH {SHAPES} SELECT mid, {_AREA} AS area_sq_km FROM shapes")
def geo_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shapes(spark, sf_dir).select("mid", geo.area_sq_km(F.col("polygons")).alias("area_sq_km"))


@query("geo_centroid", f"WITH {SHAPES} SELECT mid, round(s + dy / 2, 4) AS lat, round(w + dx / 2, 4) AS lon FROM shapes")
def geo_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geo.centroid(F.col("polygons"))
    return T.shapes(spark, sf_dir).select("mid", F.round(c["lat"], 4).alias("lat"), F.round(c["lon"], 4).alias("lon"))


@query("geo_bbox", f"WITH {SHAPES} SELECT mid, round(w, 5) AS min_lon, round(s, 5) AS min_lat, round(w + dx, 5) AS max_lon, round(s + dy + CASE WHEN key % 9 = 0 THEN 2 * dy ELSE 0 END, 5) AS max_lat FROM shapes")
def geo_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.bbox(F.col("polygons"))
    return T.shapes(spark, sf_dir).select("mid", *(F.round(b[k], 5).alias(k) for k in ("min_lon", "min_lat", "max_lon", "max_lat")))


@query("geo_type", f"WITH {SHAPES} SELECT mid, CASE WHEN key % 9 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type FROM shapes")
def geo_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shapes(spark, sf_dir).select("mid", geo.geometry_type(F.col("polygons")).alias("geom_type"))


@query("geo_out_of_bounds", f"WITH {SHAPES} SELECT mid, key % 50 = 7 AS outside FROM shapes")
def geo_out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shapes(spark, sf_dir).select("mid", geo.out_of_bounds(F.col("polygons")).alias("outside"))


@query("geo_parse_coords", "SELECT o_orderkey AS key, 2 AS n, round(-121 - (o_custkey % 50) / 100.0::DOUBLE, 4) AS lon, 37.5 AS lat FROM orders")
def geo_parse_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = F.round(-121 - (F.col("o_custkey") % 50) / 100.0, 4)
    points = geo.parse_coordinates(F.concat(F.lit("\n "), lon, F.lit(" , 37.5, 0  junk -121.2,x,0 5\n-121.3,37.6 ")))
    return _texts(spark, sf_dir, points.alias("p")).select("key", F.size("p").alias("n"), F.get("p", 0)["lon"].alias("lon"), F.get("p", 0)["lat"].alias("lat"))


def _ring(n: int):  # noqa: ANN202
    """The first n corners of a customer's rectangle."""
    return F.slice(F.get(F.get("polygons", 0), 0), 1, n)


@query("geo_close_ring", f"WITH {SHAPES} SELECT mid, CASE key % 3 WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 2 END AS n FROM shapes")
def geo_close_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.when(F.col("key") % 3 == 0, _ring(5)).when(F.col("key") % 3 == 1, _ring(3)).otherwise(_ring(2))
    return T.shapes(spark, sf_dir).select("mid", F.size(geo.close_ring(ring)).alias("n"))


@query("geo_orient", f"WITH {SHAPES} SELECT mid, round(s, 5) AS second_lat, round(s + dy, 5) AS hole_second_lat FROM shapes")
def geo_orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second corner is south-east in a counter-clockwise rectangle and north-west in a clockwise one, whatever it was."""
    ring = F.when(F.col("key") % 2 == 0, _ring(5)).otherwise(F.reverse(_ring(5)))
    second = lambda ccw: F.round(F.get(geo.orient(ring, ccw), 1)["lat"], 5)
    return T.shapes(spark, sf_dir).select("mid", second(True).alias("second_lat"), second(False).alias("hole_second_lat"))


_KML_RING = "<LinearRing><coordinates>{}</coordinates></LinearRing>"


def _kml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KML of every shape; every 19th is cut off, every 20th has only a point."""
    pair = lambda p: F.concat(p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(",0"))
    ring = lambda r: F.concat(F.lit("<LinearRing><coordinates>"), F.array_join(F.transform(r, pair), " "), F.lit("</coordinates></LinearRing>"))
    hole = lambda r: F.concat(F.lit("<innerBoundaryIs>"), ring(r), F.lit("</innerBoundaryIs>"))
    polygon = lambda p: F.concat(F.lit("<Polygon><outerBoundaryIs>"), ring(F.get(p, 0)), F.lit("</outerBoundaryIs>"), F.array_join(F.transform(F.slice(p, 2, F.size(p)), hole), ""), F.lit("</Polygon>"))
    k = F.col("key")
    body = F.when(k % 20 == 0, "<Point><coordinates>-121,37,0</coordinates></Point>").otherwise(F.array_join(F.transform("polygons", polygon), ""))
    end = F.when(k % 19 == 0, "").otherwise("</kml>")
    text = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name> '), F.col("doc_name"), F.lit(" </name><Placemark><name>Polygon 1</name><MultiGeometry>"), body, F.lit("</MultiGeometry></Placemark></Document>"), end)
    return T.shapes(spark, sf_dir).select("mid", text.alias("xml"), "key")


_KML_REASON = "CASE WHEN key % 19 = 0 OR key % 20 = 0 THEN 'no_polygon' WHEN key % 50 = 7 THEN 'out_of_bounds' END"


@query("extract_kml", f"WITH {SHAPES} SELECT mid, CASE WHEN key % 19 <> 0 THEN doc_name END AS doc_name, {_KML_REASON} AS reason, CASE WHEN key % 19 = 0 OR key % 20 = 0 THEN 0.0 ELSE {_AREA} END AS area_sq_km FROM shapes")
def extract_kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kml.shapes_of_kml(_kml_texts(spark, sf_dir).select("mid", "xml"), F.lit("2026-01-01T00:00:00Z")).select("mid", "doc_name", "reason", "area_sq_km")


@query("geo_rings", f"WITH {SHAPES} SELECT mid, CASE WHEN key % 19 = 0 OR key % 20 = 0 THEN 0 ELSE 1 + (key % 9 = 0)::INT END AS polygons, CASE WHEN key % 19 = 0 OR key % 20 = 0 THEN 0 ELSE {_RINGS} END AS rings FROM shapes")
def geo_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = kml.shapes_of_kml(_kml_texts(spark, sf_dir).select("mid", "xml"), F.lit(""))
    return built.select("mid", F.size("polygons").alias("polygons"), F.size(geo.rings(F.col("polygons"))).alias("rings"))


_KML_FAILS = "(key % 19 = 0 OR key % 20 = 0 OR key % 50 = 7)"
_SHAPES_ALL = f"""WITH {OPS}, {SHAPES}, wanted AS (SELECT * FROM shapes WHERE mid IN (SELECT mid FROM ops)) SELECT mid,
  CASE WHEN key % 4 = 0 THEN 'known' ELSE coalesce({_KML_REASON}, 'fetched') END AS state, CASE WHEN key % 4 <> 0 AND NOT {_KML_FAILS} THEN doc_name END AS doc_name,
  CASE WHEN key % 4 <> 0 AND NOT {_KML_FAILS} THEN {_ZONE_SQL} END AS zone_code, CASE WHEN key % 4 <> 0 AND NOT {_KML_FAILS} THEN 'now' END AS fetched_at,
  CASE WHEN key % 4 <> 0 AND NOT {_KML_FAILS} THEN {_AREA} END AS area_sq_km, CASE WHEN key % 4 <> 0 AND NOT {_KML_FAILS} THEN CASE WHEN key % 9 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END END AS geom_type,
  CASE WHEN key % 4 <> 0 AND NOT {_KML_FAILS} THEN 5 * {_RINGS} END AS n_points FROM wanted"""


@query("shapes_pipeline", _SHAPES_ALL)
def shapes_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted maps without a shape (a quarter is known) go through the KML reader; failures keep their reason. All columns of a shape."""
    from marshlight.plans.pipeline import resolve_shapes

    texts, ops = _kml_texts(spark, sf_dir), T.operations(spark, sf_dir)
    columns = {f.name: F.lit(None).cast(f.dataType) for f in spark.createDataFrame([], archive.SHAPE).schema} | {"mid": F.col("mid")}
    wanted = texts.join(ops.select("mid").distinct(), "mid", "left_semi")
    known = wanted.filter("key % 4 = 0").select(*(column.alias(name) for name, column in columns.items()))
    kept, failed = resolve_shapes(ops.join(texts.select("mid"), "mid", "left_semi"), known, texts.select("mid", "xml"), F.lit("now"))
    state = F.when(F.col("fetched_at").isNull(), "known").otherwise("fetched")
    points = F.when(F.col("polygons").isNotNull(), F.size(F.flatten(F.flatten("polygons"))))
    own = ["doc_name", "zone_code", "fetched_at", "area_sq_km", "geom_type"]
    read = kept.filter(F.col("mid").isNotNull()).select("mid", state.alias("state"), *own, points.alias("n_points"))
    return read.unionByName(failed.select("mid", F.col("reason").alias("state")), allowMissingColumns=True)


_FOOTPRINT = f"""WITH {SHAPES}, r AS (SELECT w AS x0, w + dx AS x1, s AS y0, s + dy AS y1 FROM shapes WHERE key % 10 <> 0 UNION ALL SELECT w, w + dx, s + 2 * dy, s + 2 * dy + dy FROM shapes WHERE key % 9 = 0
  UNION ALL SELECT w, w + dx / 4, s, s + dy FROM shapes WHERE key % 10 = 0 UNION ALL SELECT w + dx / 4 + dx / 2, w + dx, s, s + dy FROM shapes WHERE key % 10 = 0
  UNION ALL SELECT w + dx / 4, w + dx / 4 + dx / 2, s, s + dy / 4 FROM shapes WHERE key % 10 = 0 UNION ALL SELECT w + dx / 4, w + dx / 4 + dx / 2, s + dy / 4 + dy / 2, s + dy FROM shapes WHERE key % 10 = 0),
x AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM (SELECT x0 AS a FROM r UNION SELECT x1 FROM r)),
i AS (SELECT a, b, y0, y1, max(y1) OVER (PARTITION BY a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x JOIN r ON x0 <= a AND x1 >= b),
g AS (SELECT a, b, greatest(y0, coalesce(reach, y0)) AS y0, y1 FROM i WHERE reach IS NULL OR y1 > reach)
SELECT round(sum(radians(b - a) * (sin(radians(y1)) - sin(radians(y0)))) * {K.EARTH_RADIUS_KM} * {K.EARTH_RADIUS_KM}, 3) AS footprint_sq_km FROM g"""


@query("footprint_area", _FOOTPRINT)
def footprint_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground that all shapes cover together; they overlap each other many times."""
    return footprint.footprint_area(T.shapes(spark, sf_dir)).select(F.round("footprint_sq_km", 3).alias("footprint_sq_km"))


# ---------------------------------------------------------------- documents
@query("src_plausible_pages", f"SELECT page_id FROM pages WHERE length(html) >= {K.SMALLEST_PAGE}")
def src_plausible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.plausible_pages(T.load(spark, sf_dir, "pages")).select("page_id")


@query("src_cached_pages", f"""SELECT '2020' || lpad(page_id::VARCHAR, 10, '0') AS stamp, 'wayback:2020' || lpad(page_id::VARCHAR, 10, '0') AS source, length(html) AS n_chars, sha256(html) AS html_sha256
FROM pages WHERE length(html) >= {K.SMALLEST_PAGE}""")  # fmt: skip
def src_cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of a cache of captures, read back by the data source; short bodies are dropped by it."""
    folder = scratch_dir(spark, "captures")
    stamp = F.concat(F.lit("2020"), F.lpad(F.col("page_id").cast("string"), 10, "0"))
    captures.cache_captures(T.load(spark, sf_dir, "pages").select(stamp.alias("stamp"), "html"), folder)
    return captures.cached_captures(spark, folder).select("stamp", "source", F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("html_sha256"))


def _alert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert page for each page of the table: its headings, two operations of two areas, and the page's own list of links."""
    k = F.col("page_id")
    n = lambda i: F.concat(k.cast("string"), F.lit(f"_{i}"))
    link = lambda i: F.concat(F.lit('<a href="https://maps.example.com/u/0/edit?x=1&amp;mid='), n(i), F.lit('">See Map</a>'))
    area = lambda i, status: F.concat(F.lit("<li><strong>Area "), n(i), F.lit(":</strong> "), F.lit(status), F.lit("&gt;N to Road., &gt;South to Lane.. "), F.lit('<a href="?mid=blank"> </a>'), link(i), F.lit("</li>"))
    first = F.concat(F.lit("<li>Ground spraying for adult insect control using Dibrom® is scheduled for the evening of Friday, July 24, 2026, between 8:40&nbsp;p.m. and 10:00 p.m.<ul>"), area(0, "<span><b>COMPLETE</b></span>"), area(1, ""), F.lit("</ul></li>"))
    second = F.concat(F.lit("<li><ul></ul>A<strong>erial spraying</strong> for larvae on July 25, 2026 POSTPONED TO MONDAY, JULY 27, 2026<ul>"), area(2, ""), F.lit("<li>no link</li></ul></li>"))
    third = F.when(k % 5 == 0, "<li>Ground spraying some day<ul><li>x</li></ul></li>").otherwise("")
    page = F.concat(F.lit("<html><body><div><h1>Spray Alerts</h1><h2>Current Operations</h2><ul>"), first, F.lit("</ul><h2>Past Completed Operations:</h2><ul>"), second, F.lit("</ul><ul>"), third, F.lit("</ul></div>"), F.col("html"), F.lit("</body></html>"))
    return spread(T.load(spark, sf_dir, "pages")).select(F.lit("live").alias("source"), k.alias("page_ord"), page.alias("html"))


_EXTRACTED = """WITH p AS (SELECT page_id, unnest([0, 1, 2]) AS i FROM pages)
SELECT CASE WHEN i = 2 THEN '2026-07-27' ELSE '2026-07-24' END || '|' || page_id || '_' || i AS id, 'Area ' || page_id || '_' || i AS area_name, CASE WHEN i = 2 THEN 'aerial' ELSE 'ground' END AS method,
  CASE WHEN i = 2 THEN 'larval' ELSE 'adult' END AS target, CASE WHEN i < 2 THEN 'Dibrom' ELSE '' END AS products, CASE WHEN i < 2 THEN '20:40' END AS time_start, CASE i WHEN 0 THEN 'complete' WHEN 1 THEN 'scheduled' ELSE 'postponed' END AS status,
  CASE i WHEN 0 THEN 'COMPLETE' WHEN 2 THEN 'POSTPONED TO MONDAY, JULY 27, 2026' END AS status_text, CASE WHEN i = 2 THEN 'past' ELSE 'current' END AS section, 'North to Road., South to Lane.' AS boundary_text FROM p"""


@query("extract_ops", _EXTRACTED)
def extract_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = html.operations(html.extract_areas(_alert_pages(spark, sf_dir)), F.lit("2026-08-01T00:00:00Z"))
    return ops.select("id", "area_name", "method", "target", F.array_join("products", "; ").alias("products"), "time_start", "status", "status_text", "section", "boundary_text")


@query("parse_rejects", "SELECT 'no_map' AS reason, count(*) AS n FROM pages UNION ALL SELECT 'no_date', count(*) FROM pages WHERE page_id % 5 = 0")
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.rejects(html.extract_areas(_alert_pages(spark, sf_dir)))


@query("anchor_pick", "SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'text' WHEN 2 THEN 'blank' END || CASE WHEN o_orderkey % 4 < 3 THEN o_custkey::VARCHAR END AS mid FROM orders")
def anchor_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    one = lambda name, text: F.struct(F.concat(F.lit(f"/edit?a=1&mid={name}"), F.col("o_custkey")).alias("href"), F.lit(text).alias("text"))
    blank, other, good, none = one("blank", " "), one("text", "details"), one("good", "See Map"), F.struct(F.lit("/x").alias("href"), F.lit("map").alias("text"))
    anchors = F.when(k % 4 == 0, F.array(blank, other, good, none)).when(k % 4 == 1, F.array(blank, other, none, other)).when(k % 4 == 2, F.array(none, blank)).otherwise(F.array(none))
    return _texts(spark, sf_dir, html.pick_mid(anchors).alias("mid"))


@query("src_ops_json", f"WITH {OPS} SELECT id, date, status, status_text, array_to_string(products, '; ') AS products FROM ops")
def src_ops_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations written as a document in parts and read back by the archive's reader."""
    path = scratch_dir(spark, "ops-json")
    export.write_operations(T.operations(spark, sf_dir), path, "2026-01-01T00:00:00Z")
    return archive.load_operations(spark, path).select("id", "date", "status", "status_text", F.array_join("products", "; ").alias("products"))


@query("archive_roundtrip", f"""WITH {OPS}, {SHAPES} SELECT (SELECT count(*) FROM ops) AS operations, (SELECT count(*) FROM shapes) AS shapes, true AS same_operations, true AS same_shapes,
  true AS written, false AS written_again, true AS written_after_change""")  # fmt: skip
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both documents written, read and compared by fingerprints, written again with another clock, and again after a change."""
    path, shapes_path = scratch_dir(spark, "roundtrip-ops"), scratch_dir(spark, "roundtrip-shapes")
    ops = stored(T.operations(spark, sf_dir, True), "ops")
    shapes = stored(_shape_table(spark, sf_dir).select("mid", "zone_code", "doc_name", "area_sq_km", geo.geometry_type(F.col("polygons")).alias("geom_type"), "polygons"), "shapes")
    wrote = [export.write_operations(ops, path, "t1") and export.write_shapes(shapes, shapes_path), export.write_operations(ops, path, "t2") or export.write_shapes(shapes, shapes_path)]
    back, back_shapes = archive.load_operations(spark, path), archive.load_shapes(spark, shapes_path)
    held = [c for c in back.columns if c in ops.columns]
    # a document is read once: its fingerprint also counts its rows
    prints = [export.fingerprint(t).first() for t in (back.select(*held), ops.select(*held), back_shapes.select(*shapes.columns), shapes)]
    row = (prints[0]["n"], prints[2]["n"], prints[0] == prints[1], prints[2] == prints[3])
    changed = ops.withColumn("status", F.when(F.col("seq") == ops.agg(F.min("seq")).first()[0], "lost").otherwise(F.col("status")))
    wrote.append(export.write_operations(changed, path, "t3"))
    return spark.createDataFrame([(*row, *wrote)], "operations long, shapes long, same_operations boolean, same_shapes boolean, written boolean, written_again boolean, written_after_change boolean")


@query("src_shapes_json", f"WITH {SHAPES} SELECT mid, 'second' AS doc_name, CASE WHEN key % 9 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type, {_AREA} AS area_sq_km FROM shapes")
def src_shapes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape twice as GeoJSON text, the second by its id only; the last of equal mids wins."""
    geometry = F.concat(F.lit('"geometry":{"type":"'), geo.geometry_type(F.col("polygons")), F.lit('","coordinates":'), geo.geojson_coordinates(F.col("polygons")), F.lit("}}"))
    first = F.concat(F.lit('{"type":"Feature","properties":{"mid":"'), F.col("mid"), F.lit('","doc_name":"first"},'), geometry)
    second = F.concat(F.lit('{"type":"Feature","id":"'), F.col("mid"), F.lit('","properties":{"mid":"","doc_name":"second"},'), geometry)
    rows = archive.shapes_of_features(T.shapes(spark, sf_dir).select(F.posexplode(F.array(first, second)).alias("pos", "item")))
    return rows.select("mid", "doc_name", "geom_type", geo.area_sq_km(F.col("polygons")).alias("area_sq_km"))


# ---------------------------------------------------------------- exports
_EXPORT_SHAPES = SHAPES + f", s2 AS (SELECT *, {_ZONE_SQL} AS zone_code FROM shapes)"


def _shape_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shapes(spark, sf_dir).withColumn("zone_code", X.zone_code(F.col("doc_name"))).withColumn("area_sq_km", (F.col("key") % 100 / 8).cast("double"))


_NUMBER = "CASE WHEN {x} IS NULL THEN '' ELSE regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\\.$', '.0') END"


def _centroid_sql(axis: str) -> str:
    """The centroid of a customer's rectangle, by sums over its edges in their order, as the sums of doubles depend on it."""
    corners = [("w", "s"), ("(w + dx)", "s"), ("(w + dx)", "(s + dy)"), ("w", "(s + dy)"), ("w", "s")]
    edges = list(zip(corners, corners[1:], strict=False))
    cross = [f"({a[0]} * {b[1]} - {b[0]} * {a[1]})" for a, b in edges]
    k = ("lon", "lat").index(axis)
    total = lambda terms: functools.reduce(lambda done, t: f"({done} + {t})", terms, "0.0::DOUBLE")
    return f"round({total(f'({a[k]} + {b[k]}) * {c}' for (a, b), c in zip(edges, cross, strict=True))} / (3 * {total(cross)}), 6)"


_EXPORT_SQL = f"""WITH {OPS}, {_EXPORT_SHAPES} SELECT ops.id, date, method, target, array_to_string(products, '; ') AS products, coalesce(period, '') AS period, '' AS time_start, '' AS time_end, status,
  coalesce(status_text, '') AS status_text, area_name, coalesce(zone_code, '') AS zone_code, {_REGION_SQL.format(z='zone_code')} AS region, coalesce(boundary_text, '') AS boundary_text,
  {_NUMBER.format(x='(key % 100 / 8.0)::DOUBLE')} AS area_sq_km, {_NUMBER.format(x=_centroid_sql('lat'))} AS centroid_lat, {_NUMBER.format(x=_centroid_sql('lon'))} AS centroid_lon, map_url, mid AS map_id, source AS observed_via, first_seen FROM ops LEFT JOIN s2 USING (mid)"""


@query("export_rows", _EXPORT_SQL)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_rows(T.operations(spark, sf_dir), _shape_table(spark, sf_dir))


_CSV_SQL = ", ".join(f"CASE WHEN regexp_matches({c}, '[,\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END" for c in K.EXPORT_COLUMNS)


@query("export_csv", _EXPORT_SQL.replace("coalesce(boundary_text, '')", "coalesce('x, \"' || boundary_text || '\"', '')").replace("WITH ", "WITH rows_ AS (WITH ", 1) + f") SELECT date, concat_ws(',', {_CSV_SQL}) AS line FROM rows_")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV file written and its records read back as text."""
    path = scratch_dir(spark, "csv")
    ops = T.operations(spark, sf_dir).withColumn("boundary_text", F.when(F.col("boundary_text").isNotNull(), F.concat(F.lit('x, "'), "boundary_text", F.lit('"'))))
    export.write_csv(export.export_rows(ops, _shape_table(spark, sf_dir)), path)
    lines = spark.read.option("lineSep", "\r\n").text(path).filter(~F.col("value").contains("date,method,"))
    return lines.select(F.substring("value", 1, 10).alias("date"), F.col("value").alias("line"))


_CORNERS = """(5 * (1 + (key % 10 = 0)::INT + (key % 9 = 0)::INT))::BIGINT AS n_points,
  round((5 * w + 2 * dx) * (1 + (key % 9 = 0)::INT) + CASE WHEN key % 10 = 0 THEN 5 * w + 2.25 * dx ELSE 0 END, 6) AS sum_lon,
  round(5 * s + 2 * dy + CASE WHEN key % 10 = 0 THEN 5 * s + 2.25 * dy ELSE 0 END + CASE WHEN key % 9 = 0 THEN 5 * s + 12 * dy ELSE 0 END, 6) AS sum_lat"""
_FEATURES = f"SELECT id, CASE WHEN key % 9 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, id AS operation_id, status, {_CORNERS}"
_EXTENT = """(SELECT struct_pack(west := round(min(w), 6), south := round(min(s), 6), east := round(max(w + dx), 6), north := round(max(CASE WHEN key % 9 = 0 THEN s + 3 * dy ELSE s + dy END), 6)) FROM ops JOIN shapes USING (mid)) AS box"""


def _features_read(rows: DataFrame, *others) -> DataFrame:  # noqa: ANN002
    """What the exports' queries compare of features, read from their JSON: names, and count and sums of their coordinates."""
    shape = "id string, properties struct<operation_id:string,status:string>, geometry struct<type:string,coordinates:string>"
    read = rows.select(F.from_json("feature", shape).alias("f"), *others)
    numbers = F.transform(F.split(F.translate("f.geometry.coordinates", "[]", ""), ","), lambda x: x.cast("double"))
    read = read.withColumn("numbers", numbers)
    total = lambda odd: F.round(F.aggregate(F.filter("numbers", lambda _, i: i % 2 == odd), F.lit(0.0), lambda a, x: a + x), 6)
    return read.select("f.id", F.col("f.geometry.type").alias("kind"), "f.properties.operation_id", "f.properties.status", (F.size("numbers") / 2).cast("long").alias("n_points"), total(0).alias("sum_lon"), total(1).alias("sum_lat"), *others)


@query("export_geojson", f"WITH {OPS}, {SHAPES}, x AS (SELECT {_EXTENT}) {_FEATURES}, box.west AS west, box.south AS south, box.east AS east, box.north AS north, "
       "(SELECT count(*) FROM ops WHERE mid NOT IN (SELECT mid FROM shapes)) AS skipped FROM ops JOIN shapes USING (mid), x")  # fmt: skip
def export_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature with its coordinates, and beside it the extent and the count of operations without geometry."""
    ops, shapes = T.operations(spark, sf_dir), _shape_table(spark, sf_dir)
    extent = export.geojson_extent(ops, shapes).select(*(F.round(c, 6).alias(n) for n, c in zip(("west", "south", "east", "north"), sink.BOUNDS, strict=True)), "skipped")
    return _features_read(export.geojson_features(ops, shapes)).join(F.broadcast(extent))  # one row


@query("export_sink", f"WITH {OPS}, {SHAPES}, x AS (SELECT {_EXTENT}) {_FEATURES}, box.west AS west, box.south AS south, box.east AS east, box.north AS north, "
       "(SELECT count(*) FROM ops WHERE mid NOT IN (SELECT mid FROM shapes)) AS skipped, (SELECT count(*) FROM ops) AS records FROM ops JOIN shapes USING (mid), x")  # fmt: skip
def export_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both exports published by the sink, and read back: features from their document, records of the other, extent and skipped from what was published."""
    path = scratch_dir(spark, "export")
    about = sink.publish_export(T.operations(spark, sf_dir), _shape_table(spark, sf_dir), path)
    records = spark.read.option("lineSep", "\r\n").text(f"{path}/{about['folder']}/operations.csv").count() - 1
    told = {**{n: round(v, 6) for n, v in zip(("west", "south", "east", "north"), about["bbox"], strict=True)}, "skipped": about["skipped"], "records": records}
    return _features_read(sink.exported_features(spark, path)).select("*", *(F.lit(v).cast("double" if isinstance(v, float) else "long").alias(n) for n, v in told.items()))


@query("sink_change_detect", "SELECT count(*) AS n, true AS same, false AS same_after_change FROM orders")
def sink_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of a table, of the same in another order and with another clock, and of it with one value changed."""
    ops = T.operations(spark, sf_dir)
    other = ops.repartition(7, "seq").withColumn("first_seen", F.lit("later"))
    changed = ops.withColumn("status", F.when(F.col("seq") == 0, "lost").otherwise(F.col("status")))
    prints = [export.fingerprint(t, ("first_seen",)).withColumn("k", F.lit(k)) for k, t in enumerate((ops, other, changed))]
    one = prints[0].unionByName(prints[1]).unionByName(prints[2])
    value = lambda k: F.max(F.when(F.col("k") == k, F.struct("n", "h1", "h2")))
    return one.agg(F.max("n").alias("n"), (value(0) == value(1)).alias("same"), (value(0) == value(2)).alias("same_after_change"))


@query(
    "run_manifest",
    f"""WITH {OPS}, {SHAPES} SELECT (SELECT count(*) FROM ops WHERE seq % 2 = 1) AS page_ops, (SELECT count(*) FROM (SELECT id FROM ops WHERE seq % 2 = 1 EXCEPT SELECT id FROM ops WHERE seq % 2 = 0)) AS new_ops,
  (SELECT count(DISTINCT id) FROM ops) AS total_ops, (SELECT count(*) FROM shapes) AS total_shapes, (SELECT count(*) FROM shapes WHERE key % 5 <> 0) AS new_shapes,
  (SELECT count(*) FROM customer WHERE c_custkey % 41 = 40) AS shape_failures, (SELECT min(date) FROM ops) AS date_min, (SELECT max(date) FROM ops) AS date_max""",
)
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's manifest, published as a document and read back: a fifth of the shapes was known, and customers without one failed."""
    from marshlight.plans.pipeline import manifest

    ops = T.operations(spark, sf_dir).withColumn("products_raw", F.col("products"))
    existing, page = ops.filter("seq % 2 = 0"), ops.filter("seq % 2 = 1").withColumn("seq", F.col("seq") + 1_000_000_000)
    shapes, failed = T.shapes(spark, sf_dir), T.load(spark, sf_dir, "customer").filter("c_custkey % 41 = 40")
    rows = manifest(page, merge.merge_append_only(existing, page), shapes, shapes.filter("key % 5 = 0"), failed)
    path = scratch_dir(spark, "manifest")
    export.write_json(rows.first().asDict() | {"generated_at": "t"}, spark, path)
    found = export.read_json(spark, path)
    return spark.createDataFrame([tuple(found[c] for c in rows.columns)], rows.schema)


@query("observed_manifest", ORACLES["run_manifest"])
def observed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals, taken by Spark while the tables are written."""
    from marshlight.plans import pipeline

    ops = T.operations(spark, sf_dir).withColumn("products_raw", F.col("products"))
    existing, page = ops.filter("seq % 2 = 0"), ops.filter("seq % 2 = 1").withColumn("seq", F.col("seq") + 1_000_000_000)
    shapes, failed = T.shapes(spark, sf_dir), T.load(spark, sf_dir, "customer").filter("c_custkey % 41 = 40")
    return pipeline.observed_manifest(page, merge.merge_append_only(existing, page), shapes, shapes.filter("key % 5 = 0"), failed)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a day: seen in the last 30 days, in all so far, with the empty days filled in."""
    days = timeline.calendar(timeline.per_day(T.load(spark, sf_dir, "orders"), "o_orderdate"))
    return days.join(timeline.trail(days, 30), "d").join(timeline.cumulative(days), "d").orderBy("d")


__all__ = ["ORACLES", "QUERIES", "entry", "stored"]
