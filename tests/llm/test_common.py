import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm import common


@pytest.mark.parametrize("hub_rows", [1, 5, 10**6])
def test_join_keys_is_a_join(spark, monkeypatch, hub_rows):
    """Keys of any frequency, whether they are taken out of the shuffled join or not."""
    monkeypatch.setattr(common, "HUB_ROWS", hub_rows)
    rng = random.Random(hub_rows)
    rows = [(min(int(rng.paretovariate(0.7)), 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v long")
    keyed = df.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("k % 7 != 3")
    got = common.join_keys(df, keyed, "k", len(rows))
    want = df.join(keyed.drop("n"), "k")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
