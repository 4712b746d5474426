"""Instants from texts written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 8601 date and time, seconds and their fraction optional, with or without an offset.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?([Zz]|[+-]\d{2}:?\d{2})?$"


def instant(text: Column) -> Column:
    """The timestamp that ``text`` writes; a text without an offset is UTC whatever the session's zone is.

    Null for null, blank, impossible dates (month 13, year 0) and anything that is no date with a time.
    """
    t = F.upper(F.trim(text))
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    colon = F.regexp_replace(zoned, r" ?([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(t.rlike(ISO_TIME), F.try_to_timestamp(colon))
