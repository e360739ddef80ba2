"""Date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column, formats: Sequence[str] = (), on_error: str = "raise") -> Column:
    """The date in `text`: ISO first, then each of `formats`.

    Text that none fits is an error, or with on_error="null" null.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error is raise or null, not {on_error}")
    readings = [text.cast("string").try_cast("date")]
    readings += [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    if on_error == "raise":
        unread = F.raise_error(F.concat(F.lit("not a date in the formats given: "), text.cast("string"))).cast("date")
        readings.append(F.when(text.isNotNull(), unread))
    return F.coalesce(*readings)


def standardize_date(text: Column, formats: Sequence[str] = (), on_error: str = "raise") -> Column:
    return F.date_format(parse_date(text, formats, on_error), "yyyy-MM-dd")


def is_replied(reply_date: Column) -> Column:
    return reply_date.isNotNull().cast("int")


def days_to_reply(reply_date: Column, ask_date: Column) -> Column:
    return F.datediff(reply_date, ask_date)
