import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.investigation import facts
from tracewell.operators import scoring

SENTENCES = {
    "Twelve of 12 transfers, worth 3,450.75 in all, left on 2024-03-05.": [12.0, 3450.75],
    "At 10:45 it sent ₹1,00,000 and Rs.250.50; (USD 40) came back.": [100000.0, 250.5, 40.0],
    "Since March 2021 the balance fell by -12.5%, to $7!": [-12.5, 7.0],
    "In 2021 account A77 used IDs 5-9 and 3G.": [2021.0],
    "Seen Dec. 1999, again 1999.": [1999.0],
    "Moved 1.2.3 of +4, \"8\" [9] and 10km": [4.0, 8.0, 9.0],
    "": [], None: [], "no number": [], "2024-01-01T10:00:00Z and 09:00:01.5": [],
}


def test_quantities(spark):
    rows = spark.createDataFrame([(t,) for t in SENTENCES], "text string").select("text", scalars.quantities_in(F.col("text")).alias("q")).collect()
    assert {r.text: r.q for r in rows} == SENTENCES


def test_rupees_round_halves_up(spark):
    amounts = {"11250000": "₹1.13Cr", "11249999.99": "₹1.12Cr", "100000": "₹1.00L", "99999.999": "₹100.00K", "1005": "₹1.01K", "999.995": "₹1000.00", "-1125000": "₹-11.25L", "0": "₹0.00"}
    rows = spark.createDataFrame([(a,) for a in [*amounts, None]], "a string").select("a", scalars.rupees(F.col("a").cast("decimal(20,4)")).alias("t")).collect()
    assert {r.a: r.t for r in rows} == {**amounts, None: None}
    assert spark.range(1).select(scalars.rupees(F.lit(112.5e5)).alias("t")).first().t == "₹1.13Cr"


def test_mean_month_rounds_exact_sums(spark):
    when = [dt.datetime(2024, m, 3) for m in (1, 1, 2)]
    txn = spark.createDataFrame([(i, "A", "B", a, t) for i, (a, t) in enumerate(zip([0.1, 0.2, 0.01], when, strict=True))], "txn_id long, src string, dst string, amount double, ts timestamp")
    who = spark.createDataFrame([("A", "x", 12.0), ("C", "x", 12.0)], "account string, occupation string, declared_income double")
    rows = {r.account: r for r in facts.customer_profile(txn, who, F.col("declared_income") / 12).collect()}
    assert (rows["A"].mean_monthly, rows["A"].months, rows["C"].mean_monthly, rows["C"].variance) == (0.16, 2, 0.0, -100.0)


@pytest.mark.parametrize("levels", [["CRITICAL", "MEDIUM", "LOW"], ["MEDIUM", "HIGH"], ["LOW", None], ["LOW", "LOW"]])
def test_the_gravest_severity_stays(spark, levels):
    found = spark.createDataFrame([(["A", "B"], "layering", "2024-01-01", 0.5 + 0.1 * i, s) for i, s in enumerate(levels)], "account_ids array<string>, kind string, day string, score double, severity string")
    scores = spark.createDataFrame([("A", 10.0)], "account string, risk double")
    row = scoring.alert_rows(found, scores).collect()
    assert len(row) == 1 and row[0].severity == levels[0 if levels[0] != "MEDIUM" else 1] and row[0].score == round(0.5 + 0.1 * (len(levels) - 1), 6)
