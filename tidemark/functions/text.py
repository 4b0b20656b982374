"""Text forms: instants, cursors, escaping and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds


def instant_text(ts: Column) -> Column:
    """ISO-8601 in UTC with as many fraction digits as needed, in groups of three."""
    # whole numbers only, without the session's zone: the parts are cheap even where they are made twice
    micros = F.unix_micros(ts)

    def whole(value: Column, unit: int) -> Column:
        return F.call_function("div", value, F.lit(unit))

    def digits(value: Column, places: int) -> Column:
        return F.substring((value + 10**places).cast("string"), 2, places)

    in_day, in_second = F.pmod(micros, F.lit(DAY)), F.pmod(micros, F.lit(1_000_000))
    day = F.date_from_unix_date(whole(micros - in_day, DAY).cast("int")).cast("string")
    sixth = digits(in_second, 6)
    return F.concat(
        day,
        F.lit("T"),
        digits(whole(in_day, 3_600_000_000), 2),
        F.lit(":"),
        digits(whole(in_day, 60_000_000) % 60, 2),
        F.lit(":"),
        digits(whole(in_day, 1_000_000) % 60, 2),
        F.when(in_second == 0, "Z")
        .when(in_second % 1000 == 0, F.concat(F.lit("."), F.substring(sixth, 1, 3), F.lit("Z")))
        .otherwise(F.concat(F.lit("."), sixth, F.lit("Z"))),
    )


def encode_cursor(sequence: Column, ts: Column) -> Column:
    """Opaque page cursor: url-safe base64, no padding, of a one-line JSON record."""
    record = F.concat(
        F.lit('{"seq":'),
        sequence.cast("string"),
        F.lit(',"ts":"'),
        F.coalesce(instant_text(ts), F.lit("1970-01-01T00:00:00Z")),
        F.lit('","v":1}\n'),
    )
    # base64() breaks long output into lines
    plain = F.regexp_replace(F.base64(F.encode(record, "UTF-8")), r"[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def decode_cursor(cursor: Column) -> Column:
    """STRUCT<sequence, ts> of a cursor; blank means the start.

    Accepts ``seq`` or ``gp`` as the position. Text that is no cursor raises.
    """
    standard = F.translate(cursor, "-_", "+/")
    padded = F.rpad(standard, (F.ceil(F.length(standard) / 4) * 4).cast("int"), "=")
    record = F.try_parse_json(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"))
    sequence = F.coalesce(
        F.try_variant_get(record, "$.seq", "long"),
        F.try_variant_get(record, "$.gp", "long"),
        F.lit(0).cast("long"),
    )
    ts = F.coalesce(
        F.try_to_timestamp(F.try_variant_get(record, "$.ts", "string")), F.timestamp_seconds(F.lit(0))
    )
    start = F.struct(F.lit(0).cast("long").alias("sequence"), F.timestamp_seconds(F.lit(0)).alias("ts"))
    blank = cursor.isNull() | (F.trim(cursor) == "")
    return (
        F.when(blank, start)
        .when(record.isNull(), F.raise_error(F.lit("Invalid cursor format")).cast("struct<sequence:bigint,ts:timestamp>"))
        .otherwise(F.struct(sequence.alias("sequence"), ts.alias("ts")))
    )


def csv_field(value: Column) -> Column:
    """Always quoted, inner quotes doubled, NULL as an empty quoted field."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"')), F.lit('""'))


def source_string(value: Column) -> Column:
    """Escaped for a double-quoted literal in generated source text."""
    escaped = F.coalesce(value, F.lit(""))
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    return escaped


def identifier(value: Column) -> Column:
    return F.regexp_replace(value, "[^a-zA-Z0-9_]", "_")


# Event-type keywords by display class, tested in this order.
TIMELINE_CLASSES = [
    ("created", ["created", "opened", "placed", "submitted"]),
    ("deleted", ["deleted", "closed", "cancelled", "rejected"]),
    ("completed", ["completed", "resolved", "accepted", "approved", "assigned"]),
    ("failed", ["failed", "error", "blocked"]),
    ("transfer", ["transfer"]),
]
LIVE_CLASSES = [
    ("deleted", ["deleted", "closed", "cancelled", "rejected"]),
    ("withdrawn", ["withdrawn", "debit"]),
    ("deposited", ["deposited", "credit"]),
    ("created", ["created", "opened", "placed", "submitted"]),
    ("completed", ["completed", "resolved", "accepted", "approved", "assigned"]),
    ("failed", ["failed", "error"]),
    ("transfer", ["transfer"]),
]
CLASS_SCHEMES = {"timeline": TIMELINE_CLASSES, "live": LIVE_CLASSES}

# Severities from lowest to highest with their labels.
SEVERITY_LABELS = {"LOW": "Info", "MEDIUM": "Warning", "HIGH": "High", "CRITICAL": "Critical"}


def has_any_word(value: Column, words: list[str]) -> Column:
    return F.lower(value).rlike("|".join(words))


def classify_event_type(event_type: Column, scheme: str = "timeline") -> Column:
    """Display class of an event type; the first class with a matching word wins."""
    result = F
    for label, words in CLASS_SCHEMES[scheme]:
        result = result.when(has_any_word(event_type, words), label)
    return result.otherwise("default")


def severity_label(severity: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in SEVERITY_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, severity), severity)
