"""Dates as typed: one Spark expression turns a text into bounds, parts and precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import fold

# Starts of month names in English, German, French and Spanish.
MONTHS = {
    1: ("jan", "ene"), 2: ("feb", "fev"), 3: ("mar",), 4: ("apr", "avr", "abr"), 5: ("may", "mai"), 6: ("jun", "juin"),
    7: ("jul", "juil"), 8: ("aug", "aou", "ago"), 9: ("sep",), 10: ("oct", "okt"), 11: ("nov",), 12: ("dec", "dez", "dic"),
}
# Words before a date that is about, before, after or between.
ABOUT = r"\b(abt|about|c|ca|circa|cal|calc|est|um|vers|env|hacia|approx|cerca)\b"
BEFORE = r"\b(bef|before|vor|avant|antes)\b"
AFTER = r"\b(aft|after|nach|apres|despues)\b"
RANGE = r"\b(bet|between|from|to|zwischen|entre)\b"

DAY, MONTH, YEAR, LOOSE, NONE = 4, 3, 2, 1, 0


def with_dates(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a struct(precision, y, m, d, lo, hi) for each date column of `columns`, named by its value.

    precision: 4 day, 3 month, 2 year, 1 approximate, open or ranged, 0 no value (null, blank, placeholder, year 0000).
    lo and hi bound the year; open bounds reach 5 years, approximate ones 2. The steps are separate projections, so that
    no regular expression runs more than once a row.
    """
    for column, out in columns.items():
        s, parts = f"__{out}_s", f"__{out}_p"
        df = (
            df.withColumn(s, fold(F.trim(F.coalesce(F.col(column), F.lit("")))))
            .withColumn(parts, _date_parts(F.col(s)))
            .withColumn(out, _date_of(F.col(parts)))
            .drop(s, parts)
        )
    return df


def _date_parts(s: Column) -> Column:
    num = lambda c: F.when(F.length(c) > 0, c.cast("int"))
    dot = r"(\d{1,2})[./](\d{1,2})[./]\d{4}"
    return F.struct(
        F.transform(F.filter(F.regexp_extract_all(s, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1)), lambda y: y != "0000"), lambda y: y.cast("int")).alias("years"),
        F.coalesce(num(F.regexp_extract(s, r"\d{4}-(\d{1,2})(?!\d)", 1)), num(F.regexp_extract(s, dot, 2))).alias("m"),
        F.coalesce(num(F.regexp_extract(s, r"\d{4}-\d{1,2}-(\d{1,2})(?!\d)", 1)), num(F.regexp_extract(s, dot, 1))).alias("d"),
        F.regexp_extract(s, r"(?<![a-z])(jan|ene|feb|fev|mar|apr|avr|abr|may|mai|juin|juil|jun|jul|aug|aou|ago|sep|oct|okt|nov|dec|dez|dic)[a-z]*", 1).alias("word"),
        num(F.regexp_extract(s, r"(?<!\d)(\d{1,2})(?!\d)", 1)).alias("any_day"),
        F.regexp_extract(s, f"{RANGE}|{ABOUT}|{BEFORE}|{AFTER}", 0).alias("qualifier"),
    )


def _month_of(word: Column) -> Column:
    starts = F.create_map(*(F.lit(x) for m, words in MONTHS.items() for w in words for x in (w, m)))
    return F.try_element_at(starts, word)


def _date_of(p: Column) -> Column:
    q = p["qualifier"]
    about, before, after = q.rlike(ABOUT), q.rlike(BEFORE), q.rlike(AFTER)
    y1, y2 = F.get(p["years"], F.lit(0)), F.get(p["years"], F.lit(1))
    of_word = _month_of(p["word"])
    month = F.coalesce(p["m"], of_word)
    month = F.when(month.between(1, 12), month)
    day = F.coalesce(p["d"], F.when(of_word.isNotNull(), p["any_day"]))
    day = F.when(month.isNotNull() & day.between(1, 31), day)
    loose = (q != "") | y2.isNotNull()
    precision = F.when(y1.isNull(), NONE).when(loose, LOOSE).when(day.isNotNull(), DAY).when(month.isNotNull(), MONTH).otherwise(YEAR)
    lo = F.when(y2.isNotNull(), F.least(y1, y2)).when(before, y1 - 5).when(about, y1 - 2).otherwise(y1)
    hi = F.when(y2.isNotNull(), F.greatest(y1, y2)).when(after, y1 + 5).when(about, y1 + 2).otherwise(y1)
    return F.struct(
        precision.alias("precision"), y1.alias("y"), F.when(~loose, month).alias("m"), F.when(~loose, day).alias("d"), lo.alias("lo"), hi.alias("hi")
    )


# Month names of the standard form, and its words for a date that is not exact.
STANDARD_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def with_normalized_dates(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the standard form of each date column: `DD MON YYYY` with as much as is stated, after ABT, CAL, EST, BEF or AFT.

    Ranges, dates that the calendar does not have and texts without a date stay as they are, trimmed; null stays null. A
    dual year such as 1750/51 counts as its first.
    """
    for column, out in columns.items():
        s, parts = f"__{out}_s", f"__{out}_p"
        df = df.withColumn(s, fold(F.trim(F.col(column)))).withColumn(parts, _date_parts(F.regexp_replace(F.coalesce(F.col(s), F.lit("")), r"(\d{4})/\d{2}(?!\d)", "$1")))
        df = df.withColumn(out, _standard(F.col(column), F.col(s), F.col(parts))).drop(s, parts)
    return df


def _standard(raw: Column, s: Column, p: Column) -> Column:
    q = p["qualifier"]
    year, of_word = F.get(p["years"], F.lit(0)), _month_of(p["word"])
    month = F.coalesce(p["m"], of_word)
    day = F.coalesce(p["d"], F.when(of_word.isNotNull(), p["any_day"]))
    word = F.when(q.rlike(r"\bcal"), "CAL").when(q == "est", "EST").when(q.rlike(ABOUT), "ABT").when(q.rlike(BEFORE), "BEF").when(q.rlike(AFTER), "AFT")
    real = F.when(day.isNotNull(), F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).isNotNull()).otherwise(F.coalesce(month.between(1, 12), F.lit(True)))
    name = F.get(F.array(*(F.lit(m) for m in STANDARD_MONTHS)), month - 1)
    date = F.concat_ws(" ", word, F.when(month.isNotNull(), F.lpad(day.cast("string"), 2, "0")), name, F.lpad(year.cast("string"), 4, "0"))
    keep = year.isNull() | (F.size(p["years"]) != 1) | ~real | q.rlike(RANGE)
    return F.when(raw.isNotNull(), F.when(keep, F.trim(raw)).otherwise(date))


def year_of(col: Column) -> Column:
    """The first free-standing run of four digits, null if there is none."""
    year = F.regexp_extract(F.coalesce(col, F.lit("")), r"\b(\d{4})\b", 1)
    return F.when(year != "", year.cast("int"))


def date_similarity(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column, same: Column) -> Column:
    """100 for equal dates, 90 for overlapping year bounds, else 20 less for each year of gap, 0 beyond 5."""
    gap = F.greatest(a_lo - b_hi, b_lo - a_hi)
    return F.when(same, 100).when(gap <= 0, 90).when(gap <= 5, 100 - 20 * gap).otherwise(0)


def qualified_bounds(text: Column) -> Column:
    """struct(lo, hi): the years of a date with its leading word: ABT, CAL and EST allow two years, BEF one to five before, AFT after; null without a year."""
    years = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda y: y.cast("int"))
    word = F.upper(F.substring(F.trim(text), 1, 4))
    lo, hi = F.array_min(years), F.array_max(years)
    low = F.when(word.isin("ABT ", "CAL ", "EST "), lo - 2).when(word == "BEF ", lo - 5).when(word == "AFT ", lo + 1).otherwise(lo)
    high = F.when(word.isin("ABT ", "CAL ", "EST "), hi + 2).when(word == "BEF ", hi - 1).when(word == "AFT ", hi + 5).otherwise(hi)
    return F.when(F.size(years) > 0, F.struct(low.alias("lo"), high.alias("hi")))


def text_date_similarity(a: Column, b: Column) -> Column:
    """As date_similarity, of dates as texts with their leading words; 0 where one has no year, 100 for equal texts."""
    x, y = qualified_bounds(a), qualified_bounds(b)
    same = F.lower(F.trim(a)) == F.lower(F.trim(b))
    return F.when(a.isNull() | b.isNull(), None).when(same, 100).when(x.isNull() | y.isNull(), 0).otherwise(date_similarity(x["lo"], x["hi"], y["lo"], y["hi"], F.lit(False)))
