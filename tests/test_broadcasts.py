"""Tables of a row per channel are not broadcast because their files are small."""

from brinewave.operators import groups, quantization


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def samples(spark):
    return spark.range(4000).selectExpr("id % 40 AS recording_id", "1L AS channel", "CAST(id % 7 - id % 2 * 3 AS double) AS x")


def test_large_side_is_merged(spark):
    rows = spark.range(groups.BROADCAST_ROWS + 1)
    joined = rows.join(groups.per_group(rows), "id")
    assert "BroadcastHashJoin" not in plan(joined) and joined.count() == groups.BROADCAST_ROWS + 1


def test_corrections_of_many_channels(spark, monkeypatch):
    usual = sorted(map(tuple, quantization.corrections(quantization.value_counts(samples(spark))).collect()))
    monkeypatch.setattr(groups, "BROADCAST_ROWS", -1)  # not even empty ones
    found = quantization.corrections(quantization.value_counts(samples(spark)))
    assert "BroadcastHashJoin" not in plan(found)
    assert sorted(map(tuple, found.collect())) == usual and len(usual) == 40
