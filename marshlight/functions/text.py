"""Text normalisation as Column functions: headers, statuses, products, boundaries, codes and ranks."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marshlight.functions import constants as K


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def clean(text: Column) -> Column:
    """Null to "", NBSP to a blank, curly apostrophe straight, zero-width spaces out, white space collapsed and trimmed."""
    plain = F.coalesce(text, F.lit(""))
    for odd, usual in ((" ", " "), ("’", "'"), ("​", "")):  # a text without them is only searched
        plain = F.replace(plain, F.lit(odd), F.lit(usual))
    return F.trim(F.regexp_replace(plain, K.ODD_WHITE_PATTERN, " "))


def none_if_empty(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def method(header: Column) -> Column:
    return F.lower(_found(header, K.METHOD_AHEAD + K.METHOD_PATTERN))


def target(header: Column) -> Column:
    return let(F.lower(_found(header, K.FOR_AHEAD + K.TARGET_PATTERN)), lambda found: F.when(found.startswith("larv"), "larval").when(found.isNotNull(), "adult"))


def period(header: Column) -> Column:
    return F.lower(_found(header, K.FOR_AHEAD + K.PERIOD_PATTERN))


def _parts(text: Column, pattern: str, groups: str) -> Column:
    """Groups of a text that a pattern matches whole, found in one run; null stays null."""
    return F.split(F.regexp_replace(text, pattern, groups), "\n")


def clock_24h(text: Column) -> Column:
    """ "8:40 p.m." to "20:40". Hours aren't range-checked: "25:99 p.m." is "37:99". ``text`` is a match of the pattern."""

    def read(parts: Column) -> Column:
        hour, early = F.get(parts, 0).try_cast("int"), F.lower(F.get(parts, 2)) == "a"
        shifted = let(hour, lambda h: F.when(early, F.when(h == 12, 0).otherwise(h)).otherwise(F.when(h == 12, 12).otherwise(h + 12)).cast("string"))
        return F.concat(F.lpad(shifted, 2, "0"), F.lit(":"), F.get(parts, 1))

    return let(_parts(text, K.TIME_PATTERN, "$1\n$2\n$3"), read)


def times(header: Column) -> Column:
    """struct(time_start, time_end): the first two clock readings."""
    found = F.regexp_extract_all(header, F.lit(K.TIME_AHEAD + K.TIME_PATTERN), F.lit(0))
    return let(found, lambda f: F.struct(clock_24h(F.get(f, 0)).alias("time_start"), clock_24h(F.get(f, 1)).alias("time_end")))


def _to_date(text: Column) -> Column:
    """``text`` is a match of the pattern."""

    def read(parts: Column) -> Column:
        number = F.array_position(F.array(*map(F.lit, K.MONTHS)), F.lower(F.get(parts, 0))).cast("string")
        date = F.concat_ws("-", F.get(parts, 2), F.lpad(number, 2, "0"), F.lpad(F.get(parts, 1), 2, "0")).try_cast("date")
        return F.when(F.get(parts, 2).try_cast("int") >= 1, date)

    return let(_parts(text, K.DATE_PATTERN, "$1\n$2\n$3"), read)


def first_date(text: Column) -> Column:
    """struct(date, date_text): the first date in words that exists in the calendar; null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(K.DATE_AHEAD + K.DATE_PATTERN), F.lit(0)), lambda m: F.struct(_to_date(m).alias("date"), m.alias("date_text")))
    return F.get(F.filter(found, lambda x: x["date"].isNotNull()), 0)


def products_raw(header: Column) -> Column:
    """The products named after "using", in source order and wording."""
    phrase = clean(F.regexp_replace(F.regexp_extract(header, K.PRODUCT_AHEAD + K.PRODUCT_PATTERN, 1), K.PRODUCT_STOP_PATTERN, ""))
    names = F.transform(F.split(phrase, K.PRODUCT_SPLIT_PATTERN), lambda t: F.btrim(clean(F.translate(t, "®™©", "")), F.lit(" .,;:/")))
    return F.filter(names, lambda n: (n != "") & ~F.lower(n).isin("the", "a", "an"))


def canonical_product(name: Column) -> Column:
    branches = [(name.rlike(f"(?iU){pattern}"), canonical) for pattern, canonical in K.PRODUCTS]
    return functools.reduce(lambda done, b: done.when(*b), branches[1:], F.when(*branches[0]))


def canonical_products(raw: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(raw, canonical_product), lambda p: p.isNotNull()))


def display_product(products: Column) -> Column:
    """One product for an operation: the first of the canonical table's order that it has."""
    known = [canonical for _, canonical in K.PRODUCTS]
    return F.get(F.filter(F.array(*map(F.lit, known)), lambda p: F.array_contains(products, p)), 0)


def status(text: Column, cleaned: bool = False) -> Column:
    """struct(status, status_text). A phrase in capitals first; else a text that begins with a status word. ``cleaned``: the text is."""

    def kind_of(phrase: Column) -> Column:
        upper = F.upper(phrase)
        return F.when(upper.contains("CANCEL"), "cancelled").when(upper.contains("POSTPON") | upper.contains("RESCHEDUL"), "postponed").when(upper.contains("COMPLET"), "complete")

    def phrase_of(blob: Column) -> Column:
        shouted = F.regexp_substr(blob, F.lit(K.STATUS_AHEAD + K.STATUS_PHRASE_PATTERN))
        return F.btrim(clean(F.coalesce(shouted, F.when(blob.rlike(K.STATUS_START_PATTERN), blob))), F.lit(" \t.,;:-"))

    def both(phrase: Column) -> Column:
        return let(kind_of(phrase), lambda kind: F.struct(F.coalesce(kind, F.lit("scheduled")).alias("status"), F.when(kind.isNotNull(), phrase).alias("status_text")))

    return let(let(text if cleaned else clean(text), phrase_of), both)


def resolve_date(header_date: Column, kind: Column, text: Column) -> Column:
    """The date in a postponement that opens with its verb; else the header's."""
    moved = (kind == "postponed") & F.ltrim(F.upper(text)).rlike("^(POSTPONED|RESCHEDULED)")
    return F.when(moved, F.coalesce(first_date(text)["date"], header_date)).otherwise(header_date)


def inherit_status(area: Column, header: Column) -> Column:
    """struct(status, status_text): the area's if it has a text, else the header's, else scheduled."""
    none = F.struct(F.lit("scheduled").alias("status"), F.lit(None).cast("string").alias("status_text"))
    return F.when(area["status_text"].isNotNull(), area).when(header["status_text"].isNotNull(), header).otherwise(none)


def boundary(text: Column) -> Column:
    plain = clean(F.regexp_replace(clean(text), K.RESCHEDULED_NOTE_PATTERN, " "))

    def fragment(f: Column) -> Column:
        f = F.btrim(f, F.lit(" \t,;:"))
        for letter, word in K.DIRECTIONS.items():
            f = F.regexp_replace(f, rf"(?U)^{letter}\s+to\b", f"{word} to")
        return F.regexp_replace(f, r"\.{2,}", ".")

    return F.nullif(F.array_join(F.filter(F.transform(F.split(plain, ">"), fragment), lambda f: f != ""), ", "), F.lit(""))


def fallback_name(text: Column) -> Column:
    return F.when(text.contains(":"), F.substring_index(text, ":", 1)).otherwise(F.substring_index(text, ">", 1))


def mid_of_href(href: Column) -> Column:
    return _found(href, K.MID_PATTERN)


def corrected_mid(mid: Column) -> Column:
    fixes = F.create_map(*(F.lit(x) for pair in K.MISLINKED.items() for x in pair))
    return F.coalesce(fixes[mid], mid)


def zone_code(name: Column) -> Column:
    return _found(name, K.ZONE_PATTERN)


def region(zone: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in K.REGIONS.items() for x in pair))
    return F.coalesce(names[F.regexp_extract(F.coalesce(zone, F.lit("")), "^[A-Z]+", 0)], F.lit("Unknown"))


def section_kind(heading: Column) -> Column:
    """past, current, or null: keep the running section."""
    return F.when(heading.rlike(K.PAST_PATTERN), "past").when(heading.rlike(K.CURRENT_PATTERN), "current")


def observation_rank(source: Column) -> Column:
    """struct(level, stamp): live over captures (later over earlier) over anything else; null counts as the last."""
    capture = source.startswith("wayback:")
    level = F.when(source == "live", 2).when(capture, 1).otherwise(0)
    return F.struct(level.alias("level"), F.coalesce(F.when(capture, F.substring(source, 9, 1 << 20)), F.lit("")).alias("stamp"))


def since_floor(since: Column) -> Column:
    """Digits of a date or time stamp, padded to 14 with zeros; null without digits; an error under 4 or over 14 digits."""
    digits = F.regexp_replace(since, "[^0-9]", "")
    bad = ~F.length(digits).between(4, 14)
    return F.when(F.length(digits) == 0, None).when(bad, F.raise_error(F.concat(F.lit("unparseable since: "), since)).cast("string")).otherwise(F.rpad(digits, 14, "0"))


def header_fields(header: Column) -> dict[str, Column]:
    """All fields of a header sentence, each optional on its own. ``header`` is a column of cleaned text.

    ``clock`` and ``first`` are structs: (time_start, time_end) and (date, date_text).
    """
    return {
        "method": method(header), "target": target(header), "products_raw": products_raw(header), "period": period(header),
        "clock": times(header), "first": first_date(header), "header_status": status(header, cleaned=True),
    }
