import numpy as np
import pytest

from examlytics.llm.bit_table import bit_table, holds


@pytest.mark.parametrize("log", [10, 20])
def test_values_put_in_are_found(spark, log):
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    table = bit_table(spark.createDataFrame([(int(v),) for v in values], "h bigint").repartition(5), log)
    assert len(table) == (1 << log) // 8 and holds(table, values).all() and holds(table, values.view(np.uint64)).all()
    others = rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    share = np.unpackbits(table).mean()
    assert abs(holds(table, others).mean() - share) < 0.02 and share <= 300 / (1 << log)


def test_no_values(spark):
    assert not bit_table(spark.range(0).toDF("h"), 12).any()
