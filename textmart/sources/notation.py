"""Dates whose notation nobody told: how a column writes them is found by counting, then all cells are read alike.

A cell of numbers may be read day first or month first. Cells that allow only one reading decide for all cells of the
same column and separator. What no cell decides stays open and is reported, never guessed.
"""

from __future__ import annotations

import calendar
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English names and their short forms; other languages are a parameter.
MONTHS = {name.lower(): number for names in (calendar.month_name, calendar.month_abbr)
          for number, name in enumerate(names) if name}
PIVOT = 69  # years of two digits: from here on 19xx, below 20xx

DAY, MONTH, MIXED = "day", "month", "mixed"
_CELL = (r"^\s*(\p{L}+|\d{1,4})\.?([-/. ,])\s*(\p{L}+|\d{1,2})\.?[-/. ,]\s*(\d{1,4})"
         r"(?:[T,\s]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s?[AaPp][Mm])?\s?(?:Z|[+-]\d{2}:?\d{2})?)?\s*$")
_COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})\s*$"
_KINDS = ("year_first", "named", "day_first", "month_first", "same", "either", "unread")


@dataclass(frozen=True)
class Notation:
    """How one column writes its dates: which comes first, day or month, by separator; and what that leaves over."""

    orders: Mapping[str, str] = field(default_factory=dict)
    open: int = 0      # cells with two readings, and nothing to decide between them
    unread: int = 0    # cells with none


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _date(year: Column, month: Column, day: Column) -> Column:
    parts = [F.lpad(year.cast("string"), 4, "0"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string")]
    return F.concat(*parts).try_cast("date")


def _parsed(text: Column, months: Mapping[str, int]) -> Column:
    """A struct: separator, the date year first, day first and month first (each null if it is none), and the kind of cell."""
    text = text.cast("string")
    names = F.create_map(*[F.lit(v) for pair in months.items() for v in pair]) if months else None

    def month(part: Column) -> Column:
        number = part.try_cast("int")
        return number if names is None else F.coalesce(number, F.try_element_at(names, F.lower(part)))

    def parts() -> Column:
        first, separator, second, third = (F.regexp_extract(text, _CELL, i) for i in range(1, 5))
        return F.struct(first.alias("a"), separator.alias("separator"), second.alias("b"), third.alias("c"))

    def year(c: Column) -> Column:
        short = c.try_cast("int")
        return F.when(F.length(c) == 4, short).when(
            F.length(c) == 2, short + F.when(short >= PIVOT, 1900).otherwise(2000))

    def numbers(p: Column) -> Column:
        return F.struct(p["a"].alias("a"), p["separator"].alias("separator"), p["b"].alias("b"), p["c"].alias("c"),
                        month(p["a"]).alias("month_a"), month(p["b"]).alias("month_b"), year(p["c"]).alias("year"))

    def dates(p: Column) -> Column:
        digits_a, digits_b, short = p["a"].rlike(r"^\d"), p["b"].rlike(r"^\d"), F.length(p["a"]) <= 2
        compact = F.when(text.rlike(_COMPACT), F.regexp_replace(text, _COMPACT, "$1-$2-$3").try_cast("date"))
        year_first = F.coalesce(
            text.try_cast("date"),
            F.when((F.length(p["a"]) == 4) & digits_a & (F.length(p["c"]) <= 2), _date(p["a"], p["month_b"], p["c"])),
            compact)
        return F.struct(
            p["separator"].alias("separator"), (~digits_a | ~digits_b).alias("named"), year_first.alias("year_first"),
            F.when(digits_a & short, _date(p["year"], p["month_b"], p["a"])).alias("day_first"),
            F.when(digits_b & (short | ~digits_a), _date(p["year"], p["month_a"], p["b"])).alias("month_first"))

    def kinds(d: Column) -> Column:
        kind = (F.when(d["year_first"].isNotNull(), "year_first")
                .when(d["named"] & (d["day_first"].isNotNull() | d["month_first"].isNotNull()), "named")
                .when(d["day_first"] == d["month_first"], "same")
                .when(d["day_first"].isNotNull() & d["month_first"].isNotNull(), "either")
                .when(d["day_first"].isNotNull(), "day_first").when(d["month_first"].isNotNull(), "month_first")
                .otherwise("unread"))
        return F.struct(*[d[c].alias(c) for c in ("separator", "year_first", "day_first", "month_first")], kind.alias("kind"))

    return _let(_let(_let(parts(), numbers), dates), kinds)


def notations(df: DataFrame, columns: Sequence[str], months: Mapping[str, int] = MONTHS) -> DataFrame:
    """How often `columns` write dates in which way, in one aggregate: a row per column and separator.

    Counts of cells: year first, month by name, only readable day first, only month first, the same date both ways,
    another date each way, unreadable. `first` is what the cells decide (day, month, or mixed if both are needed), null
    if none does; `open` counts the cells with two dates that this leaves undecided. Null and blank cells do not count.
    """
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns])).alias("c")).select("c.*")
    parsed = cells.where(F.trim("cell") != "").select("column", _parsed(F.col("cell"), months).alias("p"))
    counted = (parsed.select("column", "p.separator", "p.kind")
               .groupBy("column", "separator")
               .agg(F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col("kind") == k).alias(k) for k in _KINDS]))
    days, others = F.col("day_first") > 0, F.col("month_first") > 0
    first = F.when(days & others, MIXED).when(days, DAY).when(others, MONTH)
    return counted.withColumn("first", first).withColumn(
        "open", F.when(F.coalesce("first", F.lit(MIXED)) == MIXED, F.col("either")).otherwise(F.lit(0).cast("long")))


def learn(df: DataFrame, columns: Sequence[str], months: Mapping[str, int] = MONTHS) -> dict[str, Notation]:
    """The notation of each of `columns`, from one pass over all of them. At most seven rows a column come back."""
    found = notations(df, columns, months).collect() if columns else []
    return {c: Notation({r["separator"]: r["first"] for r in found if r["column"] == c and r["first"] in (DAY, MONTH)},
                        sum(r["open"] for r in found if r["column"] == c),
                        sum(r["unread"] for r in found if r["column"] == c)) for c in columns}


def read(text: Column, notation: Notation, prefer: str | None = None, on_error: str = "raise",
         months: Mapping[str, int] = MONTHS) -> Column:
    """The date in `text`, as `notation` has it.

    Cells that are open are read as `prefer` says (day or month first). Without it they, and cells that are no date, are
    an error, or with on_error="null" null. Null and blank cells are null.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error is raise or null, not {on_error}")
    if prefer not in (None, DAY, MONTH):
        raise ValueError(f"prefer is {DAY}, {MONTH} or None, not {prefer}")
    parsed = _parsed(text, months)

    def chosen(p: Column) -> Column:
        first = F.lit(prefer)
        for order in (DAY, MONTH):
            of_order = [s for s, o in notation.orders.items() if o == order]
            if of_order:
                first = F.when(p["separator"].isin(of_order), order).otherwise(first)
        date = F.when(p["kind"] == "either", F.when(first == DAY, p["day_first"]).when(first == MONTH, p["month_first"])).otherwise(
            F.coalesce(p["year_first"], p["day_first"], p["month_first"]))
        if on_error == "null":
            return date
        told = F.when(p["kind"] == "either", "day or month first is not decided: ").otherwise("not a date: ")
        wrong = F.raise_error(F.concat(told, text.cast("string"))).cast("date")
        return F.coalesce(date, F.when(F.trim(text.cast("string")) != "", wrong))

    return _let(parsed, chosen)
