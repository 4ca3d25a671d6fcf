import datetime as dt

from tracewell.operators import scoring


def test_split_cuts_at_exact_shares(spark):
    # 90 accounts; 0.7 of 90 as doubles is a little less than 63
    start = dt.datetime(2024, 1, 1)
    txn = spark.createDataFrame([(2 * i, 2 * i + 1, start + dt.timedelta(minutes=i)) for i in range(45)], "src long, dst long, ts timestamp")
    got = {r.account: r.part for r in scoring.temporal_split(txn).collect()}
    assert [got[k] for k in (62, 63, 75, 76)] == ["train", "validation", "validation", "test"]


def test_context_is_not_rounded_before_it_is_printed(spark):
    row = (0.28349996 * 100, None, "dormancy", *[None] * 6)
    alerts = spark.createDataFrame([("a", *row)], "alert_id string, risk double, score double, kind string, n_accounts long, amount double, n_txns double, age_days double, prior_alerts double, velocity double")
    context = scoring.rl_context(alerts).first().context
    assert abs(context[0] - 0.28349996) < 1e-12 and len(context) == 16  # 0.2835 of six digits would be printed as such, 0.28349996 as 0.2835 and 0.28344996 as 0.2834
    more = alerts.withColumn("risk", alerts.risk * 0 + 28.3449996)
    assert f"{scoring.rl_context(more).first().context[0]:.4f}" == "0.2834"
