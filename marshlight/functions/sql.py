"""The text functions as SQL functions, for queries written as text: ``register(spark)`` makes them temporary functions.

Each is an expression over the same fixed patterns as its Column twin in ``text``, is put in place of its call by the
analyzer, and so costs what the expression costs. Structs have the twins' fields. SQL doesn't allow such functions inside
lambdas, so parts that are needed there are texts of this module.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from marshlight.functions import constants as K

_CLOCK = "STRUCT<time_start: STRING, time_end: STRING>"
_DATED = "STRUCT<date: DATE, date_text: STRING>"
_STATUS = "STRUCT<status: STRING, status_text: STRING>"


def _quoted(text: str) -> str:
    """A SQL string of any text without a quote, taken as it is."""
    return f"r'{text}'"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(map(_quoted, values))


def _let(value: str, name: str, use: str) -> str:
    """``use``, in which ``name`` stands for ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _found(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {_quoted(pattern)}, {group}), '')"


def _clean(text: str) -> str:
    plain = rf"replace(replace(replace(coalesce({text}, ''), ' ', ' '), '’', '\''), '​', '')"
    return f"trim(regexp_replace({plain}, {_quoted(K.ODD_WHITE_PATTERN)}, ' '))"


def _parts(text: str, pattern: str) -> str:
    return rf"split(regexp_replace({text}, {_quoted(pattern)}, '$1\n$2\n$3'), '\n')"


def _clock(text: str) -> str:
    hour = "CASE WHEN lower(get(c, 2)) = 'a' THEN CASE WHEN h = 12 THEN 0 ELSE h END ELSE CASE WHEN h = 12 THEN 12 ELSE h + 12 END END"
    hours = _let("try_cast(get(c, 0) AS INT)", "h", f"CAST({hour} AS STRING)")
    return _let(_parts(text, K.TIME_PATTERN), "c", f"concat(lpad({hours}, 2, '0'), ':', get(c, 1))")


def _date(text: str) -> str:
    month = f"CAST(array_position(array({_listed(K.MONTHS)}), lower(get(d, 0))) AS STRING)"
    dated = f"CASE WHEN try_cast(get(d, 2) AS INT) >= 1 THEN try_cast(concat_ws('-', get(d, 2), lpad({month}, 2, '0'), lpad(get(d, 1), 2, '0')) AS DATE) END"
    return _let(_parts(text, K.DATE_PATTERN), "d", dated)


def _first_date(text: str) -> str:
    each = f"transform(regexp_extract_all({text}, {_quoted(K.DATE_AHEAD + K.DATE_PATTERN)}, 0), m -> named_struct('date', {_date('m')}, 'date_text', m))"
    return f"get(filter({each}, x -> x.date IS NOT NULL), 0)"


def _product(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} RLIKE {_quoted(f'(?iU){pattern}')} THEN {_quoted(canonical)}" for pattern, canonical in K.PRODUCTS) + " END"


def _status(text: str) -> str:
    kind = "CASE WHEN upper(p) LIKE '%CANCEL%' THEN 'cancelled' WHEN upper(p) LIKE '%POSTPON%' OR upper(p) LIKE '%RESCHEDUL%' THEN 'postponed' WHEN upper(p) LIKE '%COMPLET%' THEN 'complete' END"
    phrase = rf"btrim({_clean(f'coalesce(regexp_substr(b, {_quoted(K.STATUS_AHEAD + K.STATUS_PHRASE_PATTERN)}), CASE WHEN b RLIKE {_quoted(K.STATUS_START_PATTERN)} THEN b END)')}, ' \t.,;:-')"
    both = _let(kind, "k", "named_struct('status', coalesce(k, 'scheduled'), 'status_text', CASE WHEN k IS NOT NULL THEN p END)")
    return _let(_let(_clean(text), "b", phrase), "p", both)


def _boundary(text: str) -> str:
    fragment = r"btrim(f, ' \t,;:')"
    for letter, word in K.DIRECTIONS.items():
        fragment = rf"regexp_replace({fragment}, r'(?U)^{letter}\s+to\b', '{word} to')"
    plain = _clean(f"regexp_replace({_clean(text)}, {_quoted(K.RESCHEDULED_NOTE_PATTERN)}, ' ')")
    return rf"nullif(array_join(filter(transform(split({plain}, '>'), f -> regexp_replace({fragment}, r'\.{{2,}}', '.')), f -> f <> ''), ', '), '')"


def _products_raw(header: str) -> str:
    phrase = _clean(f"regexp_replace(regexp_extract({header}, {_quoted(K.PRODUCT_AHEAD + K.PRODUCT_PATTERN)}, 1), {_quoted(K.PRODUCT_STOP_PATTERN)}, '')")
    names = f"transform(split({phrase}, {_quoted(K.PRODUCT_SPLIT_PATTERN)}), t -> btrim({_clean("translate(t, '®™©', '')")}, ' .,;:/'))"
    return f"filter({names}, n -> n <> '' AND lower(n) NOT IN ('the', 'a', 'an'))"


def _map(pairs: dict[str, str]) -> str:
    return f"map({_listed(tuple(x for pair in pairs.items() for x in pair))})"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name: (parameters, result type, expression)."""
    text = lambda body, result="STRING", name="x": (f"{name} STRING", result, body)
    opening = r"ltrim(upper(status_text)) RLIKE '^(POSTPONED|RESCHEDULED)'"
    none = "named_struct('status', 'scheduled', 'status_text', CAST(NULL AS STRING))"
    return {
        "clean_text": text(_clean("x")),
        "text_or_none": text("nullif(trim(x), '')"),
        "header_method": text(f"lower({_found('x', K.METHOD_AHEAD + K.METHOD_PATTERN)})"),
        "header_target": text(f"CASE WHEN lower({_found('x', K.FOR_AHEAD + K.TARGET_PATTERN)}) LIKE 'larv%' THEN 'larval' WHEN {_found('x', K.FOR_AHEAD + K.TARGET_PATTERN)} IS NOT NULL THEN 'adult' END"),
        "header_period": text(f"lower({_found('x', K.FOR_AHEAD + K.PERIOD_PATTERN)})"),
        "header_times": text(_let(f"regexp_extract_all(x, {_quoted(K.TIME_AHEAD + K.TIME_PATTERN)}, 0)", "f", f"named_struct('time_start', {_clock('get(f, 0)')}, 'time_end', {_clock('get(f, 1)')})"), _CLOCK),
        "first_date": text(_first_date("x"), _DATED),
        "products_raw": text(_products_raw("x"), "ARRAY<STRING>"),
        "canonical_product": text(_product("x")),
        "canonical_products": ("x ARRAY<STRING>", "ARRAY<STRING>", f"array_distinct(filter(transform(x, p -> {_product('p')}), p -> p IS NOT NULL))"),
        "display_product": ("x ARRAY<STRING>", "STRING", f"get(filter(array({_listed(tuple(c for _, c in K.PRODUCTS))}), p -> array_contains(x, p)), 0)"),
        "status_of": text(_status("x"), _STATUS),
        "resolve_date": ("header_date DATE, status STRING, status_text STRING", "DATE", f"CASE WHEN status = 'postponed' AND {opening} THEN coalesce({_first_date('status_text')}.date, header_date) ELSE header_date END"),
        "inherit_status": (f"area {_STATUS}, header {_STATUS}", _STATUS, f"CASE WHEN area.status_text IS NOT NULL THEN area WHEN header.status_text IS NOT NULL THEN header ELSE {none} END"),
        "boundary_text": text(_boundary("x")),
        "fallback_name": text("CASE WHEN contains(x, ':') THEN substring_index(x, ':', 1) ELSE substring_index(x, '>', 1) END"),
        "mid_of_href": text(_found("x", K.MID_PATTERN)),
        "corrected_mid": text(f"coalesce({_map(K.MISLINKED)}[x], x)"),
        "zone_code": text(_found("x", K.ZONE_PATTERN)),
        "region_of": text(f"coalesce({_map(K.REGIONS)}[regexp_extract(coalesce(x, ''), '^[A-Z]+', 0)], 'Unknown')"),
        "section_kind": text(f"CASE WHEN x RLIKE {_quoted(K.PAST_PATTERN)} THEN 'past' WHEN x RLIKE {_quoted(K.CURRENT_PATTERN)} THEN 'current' END"),
        "observation_rank": text("named_struct('level', CASE WHEN x = 'live' THEN 2 WHEN startswith(x, 'wayback:') THEN 1 ELSE 0 END, 'stamp', coalesce(CASE WHEN startswith(x, 'wayback:') THEN substring(x, 9) END, ''))", "STRUCT<level: INT, stamp: STRING>"),
        "since_floor": text(_let("regexp_replace(x, '[^0-9]', '')", "d", "CASE WHEN length(d) = 0 THEN CAST(NULL AS STRING) WHEN length(d) NOT BETWEEN 4 AND 14 THEN CAST(raise_error(concat('unparseable since: ', x)) AS STRING) ELSE rpad(d, 14, '0') END")),
        "ring_area_sq_km": ("ring ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>", "DOUBLE", f"""CASE WHEN size(ring) < 4 THEN 0D ELSE abs(aggregate(sequence(0, size(ring) - 2), 0D, (a, i) -> a + radians(get(ring, i + 1).lon - get(ring, i).lon) *
            (2 + sin(radians(get(ring, i).lat)) + sin(radians(get(ring, i + 1).lat))))) * {K.EARTH_RADIUS_KM}D * {K.EARTH_RADIUS_KM}D / 2 END"""),
        "parse_coordinates": text(
            r"filter(transform(transform(split(trim(regexp_replace(regexp_replace(coalesce(x, ''), r'(?U)\s*,\s*', ','), r'(?U)\s+', ' ')), ' '), t -> split(t, ',')), "
            "p -> named_struct('lon', try_cast(get(p, 0) AS DOUBLE), 'lat', try_cast(get(p, 1) AS DOUBLE))), p -> p.lon IS NOT NULL AND p.lat IS NOT NULL)", "ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>",
        ),
        "closed_ring": ("ring ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>", "ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>", "CASE WHEN size(ring) >= 3 AND get(ring, 0) <> get(ring, size(ring) - 1) THEN concat(ring, array(get(ring, 0))) ELSE ring END"),
    }


def register(spark: SparkSession, prefix: str = "ml_") -> list[str]:
    """Make all functions temporary functions of the session, their names after ``prefix``; the names."""
    names = []
    for name, (parameters, result, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
        names.append(f"{prefix}{name}")
    return names
