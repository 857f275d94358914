"""Normalising single values: aliases, dates, lists, numbers, codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def canonicalise(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """A column for each canonical name from its known aliases; headers match without white space and case.

    Other columns are kept, aliases that were used are not. Canonical names without any
    alias present become null columns.
    """
    squeeze = lambda s: "".join(s.split()).lower()
    have = {squeeze(c): c for c in df.columns}
    made, used = [], set()
    for name, others in aliases.items():
        present = [have[squeeze(a)] for a in (name, *others) if squeeze(a) in have]
        present = list(dict.fromkeys(present))
        used.update(present)
        made.append((first_filled(*(F.col(f"`{c}`") for c in present)) if present else F.lit(None).cast("string")).alias(name))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in used and c not in aliases), *made)


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns), F.lit(True)))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_date(c: Column) -> Column:
    """A date from 'Y-m-d H:M', 'Y-m-dTH:M:S', 'Y-m-d' or 'Ymd' in the first 19 characters; else null."""
    text = F.substring(strip(c), 1, 19)
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-M-d H:m", "yyyy-M-d'T'H:m:s", "yyyy-M-d")]
    packed = F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return F.coalesce(*tries, packed).cast("date")


def year_month(c: Column, check_month: bool = True) -> tuple[Column, Column]:
    """Year and month of a packed or dashed date; null if it isn't eight digits, or the month isn't 1..12."""
    digits = F.substring(F.regexp_replace(c, "[-/]", ""), 1, 8)
    good = digits.rlike("^[0-9]{8}$")
    year, month = F.substring(digits, 1, 4).cast("int"), F.substring(digits, 5, 2).cast("int")
    if check_month:
        good = good & F.substring(digits, 5, 2).between("01", "12")
    return F.when(good, year), F.when(good, month)


def to_list(c: Column) -> Column:
    """Trimmed, non-empty parts at '|' if there is one, at ',' otherwise; null gives an empty list."""
    text = F.coalesce(c, F.lit(""))
    parts = F.when(F.contains(text, F.lit("|")), F.split(text, r"\|")).otherwise(F.split(text, ","))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def number(c: Column) -> Column:
    """A double; what can't be read is 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def whole(c: Column) -> Column:
    """An int, by way of a double; what can't be read is null."""
    return c.try_cast("double").try_cast("int")


def sector_code(c: Column) -> Column:
    """The first code of a comma-separated list: at most five digits; null if there is none."""
    return F.nullif(F.substring(F.regexp_replace(F.split(c, ",")[0], r"\D", ""), 1, 5), F.lit(""))


def goal_tag(c: Column, most: int = 17) -> Column:
    """The leading number of a tag such as '16.5', if it is 1..most: one expression, since filters repeat it."""
    numbers = "|".join(str(n) for n in range(most, 0, -1))
    return F.regexp_extract(c, rf"^\s*0*({numbers})(?![0-9])", 1).try_cast("int")


def ladder(c: Column, steps: Sequence[tuple[float, object]], last: object) -> Column:
    """The value of the first step (bound, value) whose bound c is below; last from there on."""
    out = None
    for bound, value in steps:
        out = F.when(c < bound, value) if out is None else out.when(c < bound, value)
    return F.lit(last) if out is None else out.otherwise(last)


def share(part: Column, whole_: Column, digits: int | None = None) -> Column:
    """part / whole, null where whole is 0."""
    r = part / F.nullif(whole_, F.lit(0))
    return r if digits is None else F.round(r, digits)


def joined_text(*columns: Column) -> Column:
    """Columns with a blank between them; nulls are empty."""
    return F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def long_text(short: Column, body: Column, most: int = 300) -> Column:
    return F.concat(short, F.lit(" "), F.substring(F.coalesce(body, F.lit("")), 1, most))


def first_two_filled(*columns: Column) -> Column:
    """The first two columns that aren't blank, joined by a blank."""
    kept = F.filter(F.array(*(strip(F.coalesce(c, F.lit(""))) for c in columns)), lambda x: x != "")
    return F.array_join(F.slice(kept, 1, 2), " ")


def preview(c: Column, most: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, most)


def existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that df has, in this order."""
    return df.select(*(c for c in columns if c in df.columns))


def years_of(argument: str) -> list[int]:
    """'2010' or '2010-2016,2018' as sorted years."""
    out: set[int] = set()
    for part in argument.split(","):
        a, _, b = part.strip().partition("-")
        out.update(range(int(a), int(b or a) + 1))
    return sorted(out)
