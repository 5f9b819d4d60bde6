from pyspark.sql import functions as F

from crossload.functions import normalize as n


def values(spark, expr, given):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("v"))).collect()]


def test_phone(spark):
    got = values(spark, n.phone, ["(555) 123-4567", "+1 555 123 4567 ext. 9", "15551234567", "0000000000", "123", None])
    assert got == ["+15551234567"] * 3 + [None] * 3


def test_email(spark):
    assert values(spark, n.email, [" MailTo:A@B.co", "a@b", "a b@c.d", None]) == ["a@b.co", None, None, None]


def test_money(spark):
    assert values(spark, n.cents, ["$1,234.56", "(500.00)", "-250", " ", None]) == [123456, -50000, -25000, None, None]


def test_date(spark):
    got = values(spark, n.timestamp, ["13/45/2024", "45000", "0000-00-00", "soon", "1850-01-01", None])
    assert [str(x)[:10] for x in got] == ["2025-02-14", "2023-03-15", "None", "None", "None", "None"]


def test_tags_and_names(spark):
    assert values(spark, n.tags, ["A; b |a,C", "", None]) == [["A", "b", "C"], [], None]
    assert values(spark, n.name_key, ["José O'Brien", "", None]) == ["jose obrien", None, None]


def test_money_rounds_before_the_sign(spark):
    assert values(spark, n.cents, ["(0.125)", "-0.125", "0.125", "(-3)", "1.2.3"]) == [-13, -13, 13, -300, 120]


def test_postal(spark):
    assert values(spark, n.postal, ["K1A 0B1", " 90210 ", "902101234", "90210-1234", "ab 1", "", None]) == ["K1A 0B1", "90210", "90210-1234", "90210-1234", "AB 1", None, None]


def test_address_key(spark):
    got = values(spark, lambda c: n.address_key(c, F.lit("90210-1234")), ["12 Oak Suite 5", "12 OAK ST. Apt #5", "1 Park Way", "Street", None])
    assert got == ["12oak5|90210", "12oak5|90210", "1parkway|90210", None, None]


def test_redaction(spark):
    df = spark.createDataFrame([({"Api-Key": "x", "note": "Bearer abc", "name": "y", "gone": None},)], "m map<string,string>")
    assert df.select(n.redact(F.col("m"))).first()[0] == {"Api-Key": "[REDACTED]", "note": "[REDACTED]", "name": "y", "gone": None}


def test_rejected_files(spark):
    from crossload.operators import records as r

    df = spark.createDataFrame([("a.deb", 1, None), ("a.RPM", 1, None), ("a.hta", 1, "text/html"), ("a.txt", 1, "chemical/x"), ("a.txt", 0, "text/plain"), ("a", 2**30, None), ("a.txt", 1, "Text/plain"), ("a.txt", 1, "")], "n string, s long, k string")
    got = [x[0] for x in df.select(r.rejection(F.col("n"), F.col("s"), F.col("k"))).collect()]
    assert got == ["blocked_extension", "blocked_extension", None, "blocked_kind", "empty", "too_large", "blocked_kind", None]


def test_written_out_dates(spark):
    from crossload.functions import normalize as n

    want = {
        "Jan 5, 2024": "2024-01-05", "January 5, 2024": "2024-01-05", "5 Jan 2024": "2024-01-05", "2024/01/05": "2024-01-05", "2024-01": "2024-01-01", "2024-01-05T10:00:00Z": "2024-01-05",
        "13/45/2024": "2025-02-14", "Feb 30, 2024": None, "Jan 5": None, "2024/13/01": None, "March 1 1900": None, "": None, "soon": None}
    df = spark.createDataFrame([(k,) for k in want], "c string").select("c", F.date_format(n.timestamp(F.col("c")), "yyyy-MM-dd").alias("d"))
    assert {r.c: r.d for r in df.collect()} == want


def test_name_keys_of_many_languages(spark):
    from crossload.functions import normalize as n

    want = {"Nguyễn": "nguyen", "Ệ": "e", "José-María O’Brien": "josemaria obrien", "Łukasz": "ukasz", "ß": None, "Ġorġ": "gorg"}
    df = spark.createDataFrame([(k,) for k in want], "c string").select("c", n.name_key(F.col("c")).alias("d"))
    assert {r.c: r.d for r in df.collect()} == want
