"""Fixed values of the data contract: vocabularies, lookup tables, patterns and limits. They must stay as they are."""

from __future__ import annotations

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

#: (pattern, canonical name); the first that is found wins.
PRODUCTS = (
    ("evergreen", "Evergreen 5-25"),
    (r"delta\s*gard", "DeltaGard"),
    ("dibrom", "Dibrom"),
    ("pyronyl", "Pyronyl 525"),
    (r"vecto\s*bac", "VectoBac WDG"),
    ("altosid", "Altosid"),
)
REGIONS = {
    "D": "Delta", "E": "Escalon", "L": "Lodi", "LN": "Linden", "M": "Manteca", "MH": "Mountain House",
    "R": "Ripon", "S": "Stockton", "SC": "South County", "T": "Tracy", "TH": "Thornton",
}
MISLINKED = {"1PG7iZX-Eb0uV_kH6VfCE37SqwMoGj00c": "1JNoCNnTgawK0dNM7YpxQIOZZHDmI6jVQ"}

METHODS = ("ground", "aerial")
TARGETS = ("adult", "larval")
STATUSES = ("scheduled", "complete", "postponed", "cancelled")
SECTIONS = ("current", "past")
REQUIRED = ("id", "date", "method", "target", "area_name", "mid", "map_url", "status", "section", "source", "first_seen")
MUTABLE = ("status", "status_text", "section")
DERIVED = ("method", "target", "products", "products_raw", "period", "time_start", "time_end", "area_name", "boundary_text", "map_url")

LON_RANGE, LAT_RANGE = (-122.0, -120.5), (37.2, 38.5)
EARLIEST_DATE, HORIZON_DAYS = "2015-01-01", 60
EARTH_RADIUS_KM = 6371.0088
EARLIEST_CAPTURE, SMALLEST_PAGE = "20200814043508", 2048

MAP_URL = "https://www.google.com/maps/d/viewer?mid=%s"
KML_URL = "https://www.google.com/maps/d/kml?mid=%s&forcekml=1"
SNAPSHOT_URL = "https://web.archive.org/web/%sid_/%s"

#: White space in the JVM's dialect: what (?U)\s has, and the separators U+001C to U+001F.
WHITE_PATTERN = r"(?U)[\s\x1c-\x1f]+"
#: White space that isn't one blank already; a letter, digit or sign of ASCII is told by its range.
ODD_WHITE_PATTERN = r"(?U)(?=[^!-~])(?: [\s\x1c-\x1f]+|[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*)"
#: What the patterns below begin with, put before them: a look at one letter, and at one of ASCII before it, is cheaper than a test for the border of a word.
_BEFORE = "(?<![A-Za-z0-9_])"
STATUS_AHEAD, TIME_AHEAD, DATE_AHEAD, PRODUCT_AHEAD = "(?=[CPR])", r"(?U)(?=[^\x00-/:-\x7f])(?=\d)", "(?=[JFMASONDjfmasond\u017f])" + _BEFORE, "(?=[Uu])" + _BEFORE
METHOD_AHEAD, FOR_AHEAD = "(?=[AaGg])" + _BEFORE, "(?=[Ff])" + _BEFORE
#: Patterns in the JVM's dialect.
METHOD_PATTERN = r"(?iU)\b(aerial|ground)\s+spray"
TARGET_PATTERN = r"(?iU)\bfor\s+(adult|larval|larvae)\b"
PERIOD_PATTERN = r"(?iU)\bfor the (morning|evening|afternoon|night)\s+of\b"
TIME_PATTERN = r"(?iU)\b(\d{1,2}):(\d{2})\s*([ap])\.?\s*m\.?"
DATE_PATTERN = r"(?iU)\b(" + "|".join(MONTHS) + r")\s+(\d{1,2})(?:st|nd|rd|th)?\s*,?\s+(\d{4})\b"
PRODUCT_PATTERN = r"(?isU)\busing\b(.*?)(?:,?\s*\b(?:is|are|was|were|will)\b|\bfor\s+the\s+(?:morning|evening|afternoon|night)\b|$)"
PRODUCT_STOP_PATTERN = r"(?isU)\b(?:" + "|".join((*MONTHS, *WEEKDAYS)) + r"|between|depending|\d{1,2}:\d{2}\s*[ap]\.?m|\d{4})\b.*$"
PRODUCT_SPLIT_PATTERN = r"(?iU)\s*(?:\band/or\b|\bor\b|\band\b|&|,)\s*"
STATUS_PHRASE_PATTERN = r"(?U)\b(?:COMPLETED|COMPLETE|POSTPONED|CANCELL?ED|RESCHEDULED)\b[^a-z]*"
STATUS_WORD_PATTERN = r"(?U)\b(?:COMPLETED|COMPLETE|POSTPONED|CANCELL?ED|RESCHEDULED)\b"
STATUS_START_PATTERN = r"(?iU)^(?:completed|complete|postponed|cancell?ed|rescheduled)\b"
RESCHEDULED_NOTE_PATTERN = r"(?iU)\((?:re)?scheduled\s+from[^)]*\)"
MID_PATTERN = r"[?&]mid=([A-Za-z0-9_\-]+)"
PAST_PATTERN = r"(?iU)\bpast\b|\bcompleted\b|\bprevious(ly)?\b|\barchive"
CURRENT_PATTERN = r"(?iU)\bcurrent\b|\bupcoming\b|\bscheduled\b"
ZONE_PATTERN = r"^\s*([A-Z]{1,3}-?\d{1,3}[A-Za-z]?(?:\([A-Za-z0-9]\))?)(?=$|[\s:,.\-_])"
DIRECTIONS = {"N": "North", "S": "South", "E": "East", "W": "West"}
NAME_SEPARATORS = (":", "-", "–", "—", ".", ";", ",", ":-")

#: Elements of a page: those that may stand before and inside a status, bold ones, headings, and the most letters of a heading without one.
INLINE_ELEMENTS = frozenset(("span", "strong", "b", "em", "i", "u", "font", "mark"))
BOLD_ELEMENTS, HEADING_ELEMENTS = ("b", "strong"), ("h1", "h2", "h3", "h4", "h5", "h6")
HEADING_LETTERS = 120
#: Charsets of responses, by the names that they are given.
CHARSETS = ((("ISO-8859-1", "LATIN1", "LATIN-1", "WINDOWS-1252", "CP1252"), "ISO-8859-1"), (("US-ASCII", "ASCII"), "US-ASCII"), (("UTF-16",), "UTF-16"))

EXPORT_COLUMNS = (
    "date", "method", "target", "products", "period", "time_start", "time_end", "status", "status_text", "area_name",
    "zone_code", "region", "boundary_text", "area_sq_km", "centroid_lat", "centroid_lon", "map_url", "map_id",
    "observed_via", "first_seen",
)
