"""Countries of places, as Spark expressions and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Countries under other names, punctuation read as blanks.
COUNTRY_ALIASES = {
    "america": "united states", "england": "united kingdom", "great britain": "united kingdom", "scotland": "united kingdom", "u k": "united kingdom", "uk": "united kingdom",
    "united states of america": "united states", "us": "united states", "u s": "united states", "usa": "united states", "u s a": "united states", "wales": "united kingdom",
}
# Names that count as a country at the end of a place.
KNOWN_COUNTRIES = (
    "united states", "united kingdom", "argentina", "australia", "austria", "belgium", "brazil", "bulgaria", "canada", "chile", "china", "croatia", "cuba", "czech republic",
    "czechoslovakia", "denmark", "estonia", "finland", "france", "germany", "greece", "hungary", "iceland", "india", "ireland", "israel", "italy", "japan", "latvia", "lithuania",
    "luxembourg", "mexico", "netherlands", "new zealand", "norway", "poland", "portugal", "prussia", "romania", "russia", "serbia", "slovakia", "slovenia", "south africa",
    "soviet union", "spain", "sweden", "switzerland", "turkey", "ukraine", "yugoslavia",
)


def country(col: Column) -> Column:
    """The lower-case country, its usual name where it is written another way; null for null and blank."""
    name = F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))
    usual = F.create_map(*(F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair))
    return F.when(name != "", F.coalesce(F.try_element_at(usual, name), name))


def country_of_place(col: Column) -> Column:
    """The country named by the last part of a place, if it is a known one."""
    last = country(F.element_at(F.split(col, ","), -1))
    return F.when(last.isin(*KNOWN_COUNTRIES), last)


def country_sql(text: str) -> str:
    name = f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    cases = " ".join(f"when '{a}' then '{u}'" for a, u in COUNTRY_ALIASES.items())
    return f"case when {name} <> '' then case {name} {cases} else {name} end end"
