"""Readers of the JSON archive, of capture tables and of cached pages. ``operations.export`` writes the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.functions import geo
from marshlight.sources import versions

OPERATION = (
    "id string, date string, method string, target string, products array<string>, products_raw array<string>, period string, time_start string, "
    "time_end string, area_name string, boundary_text string, mid string, map_url string, status string, status_text string, section string, "
    "source string, first_seen string"
)
#: What else is read of an operation: its keys outside the contract, as one variant, and which of the keys that an observation
#: may change it has (null: all of them).
OPERATION_READ = f"{OPERATION}, more variant, present array<string>"
OPERATION_FIELDS = frozenset(field.split()[0] for field in OPERATION.split(", "))
SHAPE = f"mid string, zone_code string, doc_name string, doc_description string, fetched_at string, area_sq_km double, geom_type string, polygons {geo.POLYGONS}"
_PROPERTIES = "mid string, zone_code string, doc_name string, doc_description string, fetched_at string, area_sq_km double"
_FEATURE = f"struct<id:string, properties:struct<{_PROPERTIES.replace(' string', ':string').replace(' double', ':double')}>, geometry:struct<type:string, coordinates:string>>"


def json_items(document: Column, member: str) -> Column:
    """Elements of a JSON document as texts: of a bare list, or of an object's list ``member``; anything else is an error."""
    bare = F.ltrim(document).startswith("[")
    member_text = F.get_json_object(document, f"$.{member}")
    listing = F.when(bare, document).when(member_text.startswith("["), member_text).otherwise(F.raise_error(F.lit(f"no list of {member}")).cast("string"))
    return F.from_json(listing, "array<string>", {"mode": "FAILFAST"})


def _items(spark: SparkSession, path: str, member: str, lenient: bool, version: int | None = None) -> DataFrame | None:
    """(pos, item) of a document: a file that holds it, or the parts that were published at ``path``; None if there is none.

    ``pos`` orders the elements as they are in the document: part, place of the split in it, and line in the split.
    """
    folder = versions.current_folder(spark, path, version)
    if folder is not None:
        frame = (F.col("value").startswith("{") & F.col("value").endswith("[")) | (F.col("value") == "]}")
        pos = F.struct(F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
        # null in place of the frame, whatever order Spark gives to filters
        lines = spark.read.text(folder).select(pos.alias("pos"), F.when(~frame, F.regexp_replace("value", ",$", "")).alias("item"))
        return lines.filter("item is not null")
    if not versions.exists(spark, path):
        return None
    text = spark.read.text(path, wholetext=True)
    if lenient:
        text = text.filter(F.try_parse_json("value").isNotNull())
    listed = text.select(F.posexplode(json_items(F.col("value"), member)).alias("line", "item"))
    return listed.select(F.struct(F.lit("").alias("part"), F.lit(0).cast("long").alias("split"), F.col("line").cast("long").alias("line")).alias("pos"), "item")


def operations_of_items(items: DataFrame, *others: str) -> DataFrame:
    """OPERATION_READ, and the columns ``others``, of elements' texts (item). Elements that aren't objects are left out."""
    objects = items.filter(F.ltrim("item").startswith("{"))
    # a generator of one row: an element is parsed once, though the filter below and the fields need what is parsed
    parsed = F.stack(F.lit(1), F.from_json("item", OPERATION, {"mode": "FAILFAST"}), F.json_object_keys("item")).alias("o", "keys")
    extra = F.map_filter(F.from_json("item", "map<string,variant>"), lambda k, _: ~k.isin(*OPERATION_FIELDS))
    unknown = F.size(F.array_except("keys", F.array(*map(F.lit, sorted(OPERATION_FIELDS))))) > 0
    read = objects.select("item", parsed, *others).filter("o is not null")  # the filter keeps all fields, so a count finds errors too
    return read.select("o.*", F.when(unknown, F.to_variant_object(extra)).alias("more"), F.array_intersect("keys", F.array(*map(F.lit, K.MUTABLE))).alias("present"), *others)


def load_operations(spark: SparkSession, path: str, lenient: bool = False, version: int | None = None, ordinal: str | None = None) -> DataFrame:
    """Operations of a JSON document; none if it is missing; an error if it is corrupt. Elements that aren't objects are left out.

    A single file is one value and is read by one task; a document published in parts is read by lines, in parallel.
    Keys outside the contract stay together in the variant ``more``, and ``present`` lists which of status, status_text and
    section an element has. ``lenient``: a document that isn't JSON counts as missing, for readers that only compare.
    ``version``: one of a published document, by default the newest. ``ordinal``: a column for the elements' order.
    """
    items = _items(spark, path, "operations", lenient, version)
    if items is None:
        return spark.createDataFrame([], OPERATION_READ + (f", {ordinal} struct<part:string,split:bigint,line:bigint>" if ordinal else ""))
    return operations_of_items(items.withColumnRenamed("pos", ordinal), ordinal) if ordinal else operations_of_items(items)


def load_shapes(spark: SparkSession, path: str, lenient: bool = False, version: int | None = None) -> DataFrame:
    """Shapes of a GeoJSON document, the last of equal mids; a feature's mid is properties.mid or else id, without either it goes.
    Read as ``load_operations`` reads."""
    items = _items(spark, path, "features", lenient, version)
    return spark.createDataFrame([], SHAPE) if items is None else shapes_of_features(items)


def decode(content: Column, content_type: Column) -> Column:
    """The text of a response body: by the charset that its type states; without one UTF-8, or Latin-1 where that can't be.
    Bytes that the charset doesn't have are replaced, and an unknown charset counts as none."""
    stated = F.upper(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_\-]+)", 1))
    plain = content.cast("string")
    fallback = F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode(content, "ISO-8859-1"))
    text = F.when(stated.isin("UTF-8", "UTF8"), F.make_valid_utf8(plain))
    for names, charset in K.CHARSETS:
        text = text.when(stated.isin(*names), F.decode(content, charset))
    return text.otherwise(fallback)


def shapes_of_features(items: DataFrame) -> DataFrame:
    """(pos, item: a feature's JSON) to the shapes table."""
    f = items.select("pos", F.from_json("item", _FEATURE, {"mode": "FAILFAST"}).alias("f")).filter("f is not null").select("pos", "f.*")
    numbers = lambda kind: F.from_json("geometry.coordinates", kind)
    as_points = lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat"))))
    polygons = F.when(F.col("geometry.type") == "Polygon", F.array(as_points(numbers("array<array<array<double>>>")))).when(F.col("geometry.type") == "MultiPolygon", F.transform(numbers("array<array<array<array<double>>>>"), as_points))
    mid = F.coalesce(F.nullif(F.col("properties.mid"), F.lit("")), F.nullif(F.col("id"), F.lit("")))
    rows = f.select("pos", mid.alias("mid"), *(F.col(f"properties.{c}") for c in ("zone_code", "doc_name", "doc_description", "fetched_at", "area_sq_km")), F.col("geometry.type").alias("geom_type"), polygons.cast(geo.POLYGONS).alias("polygons"))
    rows = rows.filter("mid is not null")
    return rows.groupBy("mid").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("mid", "pos")]), "pos").alias("s")).select("mid", "s.*")


def capture_table(raw: Column) -> Column:
    """Rows of a capture listing: an array of arrays whose first names the columns. array<struct<ts,statuscode,digest,ord>>;
    empty stays empty, a missing column is an error."""
    table = F.from_json(raw, "array<array<string>>")
    head = F.get(table, 0)

    def column(name: str) -> Column:
        place = F.array_position(head, F.lit(name))
        return F.when(place == 0, F.raise_error(F.lit(f"capture listing without {name}")).cast("long")).otherwise(place)

    rows = F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))
    cell = lambda r, name: F.get(r, (column(name) - 1).cast("int"))
    return F.transform(rows, lambda r, i: F.struct(cell(r, "timestamp").alias("ts"), cell(r, "statuscode").alias("statuscode"), cell(r, "digest").alias("digest"), i.alias("ord")))


def plausible_pages(pages: DataFrame, text: str = "html") -> DataFrame:
    """Pages long enough to be real; shorter bodies count as failures."""
    return pages.filter(F.length(text) >= K.SMALLEST_PAGE)


def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(source, html) of cached captures ``<14 digits>.html``, which are kept as UTF-8; other bytes are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    stamp = F.regexp_extract("path", r"([0-9]{14})\.html$", 1)
    pages = files.select(F.concat(F.lit("wayback:"), stamp).alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("html")).filter(stamp != "")
    return plausible_pages(pages)


def map_url(mid: Column) -> Column:
    return F.format_string(K.MAP_URL, mid)


def kml_url(mid: Column) -> Column:
    return F.format_string(K.KML_URL, mid)


def snapshot_url(stamp: Column, page: str) -> Column:
    return F.format_string(K.SNAPSHOT_URL, stamp, F.lit(page))


def sorted_operations(ops: DataFrame) -> DataFrame:
    """By (date, id), nulls as empty texts."""
    return ops.orderBy(F.coalesce("date", F.lit("")), F.coalesce("id", F.lit("")))


def sorted_backfill(ops: DataFrame) -> DataFrame:
    return ops.orderBy(*(F.coalesce(c, F.lit("")) for c in ("date", "area_name", "mid")))
