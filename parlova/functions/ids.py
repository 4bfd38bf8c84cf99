"""Flag, timestamp and id normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlova.functions.text import strip

# Weekday names, and the layout of the text timestamp after one.
WEEKDAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
TWEET_TIME = "MMM dd HH:mm:ss Z yyyy"


def normalize_flag(col: Column) -> Column:
    """True only for the text 'true' in any case; null and all else are False."""
    return F.coalesce(F.lower(strip(col.cast("string"))) == "true", F.lit(False))


def parse_created_at(col: Column) -> Column:
    """UTC timestamp; anything unreadable becomes null."""
    named = F.when(F.rlike(col, F.lit(f"^({WEEKDAYS}) ")), F.substr(col, F.lit(5)))
    weekday_layout = F.try_to_timestamp(named, F.lit(TWEET_TIME))
    return F.coalesce(weekday_layout, col.try_cast("timestamp"))


def first_valid_id(col: Column) -> Column:
    """First id of a comma list; blank and 'nan' become null."""
    text = strip(col.cast("string"))
    first = strip(F.get(F.split(text, ","), F.lit(0)))
    return F.when(F.lower(text) != "nan", F.nullif(first, F.lit("")))


def row_digest(*cols: str) -> Column:
    """SHA-256 of the values, with lengths so that no two rows share an encoding."""
    parts = []
    for c in cols:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("~")))
    return F.unhex(F.sha2(F.concat(*parts), 256))
