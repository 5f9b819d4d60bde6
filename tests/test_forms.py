import datetime

import pytest
from pyspark.sql import functions as F

from crossload.operators import forms


@pytest.mark.parametrize("entity", list(forms.FORMS))
def test_form_of_nothing(spark, entity):
    """A record without any field has the defaults, and an empty table the columns."""
    df = spark.createDataFrame([(1,)], "k int")
    row = forms.project(df, entity, "k").first().asDict()
    want = {c: {"name": d, "yes": True, "no": False, "number": d, "json": d, "currency": d}.get(kind) for c, kind, _, d in forms.FORMS[entity]}
    assert row == {"k": 1} | want
    assert forms.project(df.limit(0), entity).count() == 0


def test_form_of_a_contact(spark):
    df = spark.sql(
        "SELECT 'Ana' first_name, '' last_name, 'a@x.y' email, array('b@x.y') secondary_emails, named_struct('line1', '1 Oak St', 'line2', null, 'city', 'Town', 'state', 'OH', 'postal_code', '12345-6789', 'country', 'US') address,"
        " array('A', 'é\"') tags, map('k', 'v', 'n', null) custom_fields, TIMESTAMP '2024-01-02 03:04:05' source_created_at, 'clash' normalized_name_key")
    row = forms.project(df, "contact").first()
    assert row.last_name is None and row.normalized_name_key == "ana" and row.address_key == "1oak|12345" and row.phone is None
    assert row.secondary_emails == '["b@x.y"]' and row.tags == '["A","é\\""]' and row.custom_fields == '{"k":"v","n":null}' and row.secondary_phones == "[]"
    assert row.address_json == '{"line1":"1 Oak St","line2":null,"city":"Town","state":"OH","postal_code":"12345-6789","country":"US"}'
    assert row.source_created_at == datetime.datetime(2024, 1, 2, 3, 4, 5) and row.source_updated_at is None


def test_form_of_a_deal(spark):
    df = spark.sql("SELECT 'x' name, named_struct('amount_cents', -50L, 'currency', '') value UNION ALL SELECT '', named_struct('amount_cents', null, 'currency', 'CAD') UNION ALL SELECT null, null")
    got = {(r.name, r.value_cents, r.currency) for r in forms.project(df, "opportunity").collect()}
    assert got == {("x", -50, "USD"), (None, None, "CAD"), (None, None, "USD")}


def test_validation_spoils_no_other(spark):
    df = spark.createDataFrame([("a", 1), ("", 1), (None, None), ("b", None)], "id string, n int")
    good, bad = forms.validated(df, {"id": F.col("id") != "", "n": F.col("n") > 0})
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert {(r.id, tuple(r.issues)) for r in bad.collect()} == {("", ("id",)), (None, ("id", "n")), ("b", ("n",))}
