"""Header-date parsing (D3): one instant and one wall-clock time per message.

Spark's parser refuses day-of-week letters, so the weekday prefix and the
trailing zone comment are cut first.  ``event_ts`` is the instant (TIMESTAMP)
and orders rows; ``local_ts`` is the wall time written in the header
(TIMESTAMP_NTZ) and drives hour, weekday, month and date filters.  Anything
unparseable is NULL (never an error), so ANSI mode stays on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in order on the cleaned header (instant, with zone).
INSTANT_FORMATS = [
    "d MMM yyyy HH:mm:ss xx",
    "d MMM yyyy HH:mm:ss z",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "d MMM yyyy HH:mm xx",
    "yyyy-MM-dd HH:mm:ss xx",
    "yyyy-MM-dd HH:mm:ssXXX",
    "d MMM yy HH:mm:ss xx",
]
# Formats tried in order on the header with the zone cut off (wall time).
WALL_FORMATS = [
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "d MMM yy HH:mm:ss",
]


# A zone at the end of a header: an offset (after a blank or a time) or a name.
ZONE = r"\s+(?:[+-]\d{2}:?\d{2}|[A-Za-z]{1,5})$|(?<=:\d{2})(?:[+-]\d{2}:?\d{2}|Z)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_header(date_header) -> Column:
    """Cut a leading 'Www,' weekday and a trailing '(comment)'."""
    s = F.regexp_replace(_c(date_header), r"^\s*[A-Za-z]{3},\s*", "")
    s = F.regexp_replace(s, r"\s*\([^)]*\)\s*$", "")
    return F.trim(s)


def _wall_part(clean: Column) -> Column:
    return F.trim(F.regexp_replace(clean, ZONE, ""))


def parse_event_ts(date_header) -> Column:
    """Instant of a header date (TIMESTAMP, UTC session) or NULL."""
    c = clean_header(date_header)
    inst = [F.try_to_timestamp(c, F.lit(f)) for f in INSTANT_FORMATS]
    wall = [F.try_to_timestamp(_wall_part(c), F.lit(f)) for f in WALL_FORMATS]
    # A header without any zone is read as UTC; one with a zone that no format reads is NULL.
    return F.coalesce(*inst, F.when(~c.rlike(ZONE), F.coalesce(*wall)))


def parse_local_ts(date_header) -> Column:
    """Wall time written in the header (TIMESTAMP_NTZ) or NULL."""
    c = clean_header(date_header)
    w = _wall_part(c)
    return F.coalesce(*[F.try_to_timestamp(w, F.lit(f)) for f in WALL_FORMATS]).cast("timestamp_ntz")


def with_parsed_dates(df, date_col: str = "date"):
    """Add ``event_ts`` and ``local_ts``; rows where either fails stay with
    NULLs (dropped by ``drop_bad_dates``).

    The formats are tried once per row: the two parses come out of a generator
    over a list of one, below which the optimizer pushes no filter, so a filter
    on the dates reads them instead of a copy of the parse."""
    tmp = df.withColumn("_hdr", clean_header(date_col)).withColumn("_cut", _wall_part(F.col("_hdr")))
    wall = F.coalesce(*[F.try_to_timestamp(F.col("_cut"), F.lit(f)) for f in WALL_FORMATS])
    inst = F.coalesce(*[F.try_to_timestamp(F.col("_hdr"), F.lit(f)) for f in INSTANT_FORMATS])
    both = F.inline(F.array(F.struct(wall.alias("_wall"), inst.alias("_inst"))))
    tmp = tmp.select("*", both)
    # a header without any zone is read as UTC
    event = F.coalesce("_inst", F.when(F.col("_hdr") == F.col("_cut"), F.col("_wall")))
    return (tmp.withColumn("event_ts", F.when(F.col("_wall").isNotNull(), event))
            .withColumn("local_ts", F.when(event.isNotNull(), F.col("_wall").cast("timestamp_ntz")))
            .drop("_hdr", "_cut", "_wall", "_inst"))
