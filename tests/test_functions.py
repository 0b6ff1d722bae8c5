import pytest
from pyspark.sql import functions as F

from stemma.functions import places, text
from stemma.functions.dates import with_dates, year_of
from stemma.functions.ocr import normalize_line_text

DATES = {
    "7 AUG 1780": (4, 1780, 8, 7), "1807-08-22": (4, 1807, 8, 22), "28.04.1927": (4, 1927, 4, 28), "27. Februar 1752": (4, 1752, 2, 27), "March 20, 1970": (4, 1970, 3, 20), "15jan1821": (4, 1821, 1, 15),
    "11 juillet 1716": (4, 1716, 7, 11), "4 août 1836": (4, 1836, 8, 4), "22 décembre 1915": (4, 1915, 12, 22), "9. März 1755": (4, 1755, 3, 9), "AUG 1805": (3, 1805, 8, None), "1890-02": (3, 1890, 2, None),
    "1762": (2, 1762, None, None), "year 1693": (2, 1693, None, None), "ABT 1810": (1, 1810, None, None), "c. 1697": (1, 1697, None, None), "vers 1720": (1, 1720, None, None), "AFT 1751": (1, 1751, None, None),
    "before 1733": (1, 1733, None, None), "BET 1771 AND 1774": (1, 1771, None, None), "0000": (0, None, None, None), "--": (0, None, None, None), "": (0, None, None, None), "unknown": (0, None, None, None), "n.d.": (0, None, None, None),
}


def test_dates(spark):
    rows = spark.createDataFrame([*((d,) for d in DATES), (None,)], "t string")
    got = {r["t"]: tuple(r["d"][k] for k in ("precision", "y", "m", "d")) for r in with_dates(rows, {"t": "d"}).collect()}
    assert got.pop(None) == (0, None, None, None)
    assert got == DATES


def test_normalized_dates(spark):
    from stemma.functions.dates import with_normalized_dates

    want = {
        "7 aug 1780": "07 AUG 1780", "1807-08-22": "22 AUG 1807", "ca. 1697": "ABT 1697", "AFT 3 Mar 1751": "AFT 03 MAR 1751", "1750/51": "1750", "BET 1771 AND 1774": "BET 1771 AND 1774", "31 FEB 1900": "31 FEB 1900",
        "soon": "soon", "": "", "March 1919": "MAR 1919", "est 1810": "EST 1810", "before 1733": "BEF 1733", "CAL 1926": "CAL 1926",
    }
    got = with_normalized_dates(spark.createDataFrame([*((d,) for d in want), (None,)], "t string"), {"t": "d"}).collect()
    assert {r["t"]: r["d"] for r in got} == want | {None: None}


@pytest.mark.parametrize(("name", "parts"), [("Ann Mary /Smith/", ("Ann Mary", "Smith")), ("Ann Smith", ("Ann", "Smith")), ("Ann", ("Ann", "")), ("", ("", "")), (None, ("", "")), ("/Smith/", ("", "Smith"))])
def test_name_split(spark, name, parts):
    assert tuple(spark.createDataFrame([(name,)], "n string").select(text.name_split(F.col("n")).alias("x")).first()["x"]) == parts


def test_text(spark):
    df = spark.createDataFrame([("  Größe   É́ ß ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.fold(text.squash(F.col("t")))).collect()] == ["grosse e ss", None, ""]
    assert [r[0] for r in df.select(text.filled(F.col("t")).isNull()).collect()] == [False, True, True]
    assert df.select(text.key_text(F.lit("O'Neil-2 X"), 5)).first()[0] == "oneil"
    assert df.select(year_of(F.lit("born 1801 or 1802"))).first()[0] == 1801


def test_country(spark):
    got = spark.createDataFrame([("Ely, England",), ("Paris,  France ",), ("Nowhere, Atlantis",), (None,), ("",)], "p string").select(places.country_of_place(F.col("p"))).collect()
    assert [r[0] for r in got] == ["united kingdom", "france", None, None, None]


def test_ocr():
    assert normalize_line_text("Ça  va\n\n Ça va \nﬁn") == "Ca va\nfin"
    assert normalize_line_text(None) is None
    assert normalize_line_text("") == ""
