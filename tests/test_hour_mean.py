"""The mean hour and the deviation from it are shown together."""

from riskspark.plans.q_features import QUERIES


def test_mean_hour_comes_with_its_deviation(spark, sf):
    got = QUERIES["w_hour_mean_30d"](spark, sf)
    assert got.columns == ["transaction_id", "user_mean_hour_30d", "user_hourly_tx_deviation"]
