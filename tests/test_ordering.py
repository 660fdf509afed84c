import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF_SMALL
from examlytics.operators.ordering import bucketed_rank
from examlytics.plans import fixtures as fx


@pytest.mark.parametrize("bucket", [1, 2, 7, 1000])
def test_bucketed_rank_equals_row_number(spark, bucket):
    # one hot group with most rows, plus small groups; gaps in the ordering key
    df = spark.range(0, 3000).select(
        F.when(F.col("id") < 2500, F.lit(0)).otherwise(F.col("id") % 7).alias("g"),
        (F.col("id") * 3).alias("o"))
    got = bucketed_rank(df.withColumn("b", F.floor(F.col("o") / bucket)), "g", "o", "b", "pos")
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert sorted(map(tuple, got.select("g", "o", "pos").collect())) == \
        sorted(map(tuple, want.select("g", "o", "pos").collect()))


@pytest.mark.parametrize("bucket", [1, 2, 3])
def test_qa_independent_of_bucket_size(spark, bucket):
    base = sorted(map(tuple, fx.qa(spark, SF_SMALL).collect()), key=str)
    small = sorted(map(tuple, fx.qa(spark, SF_SMALL, bucket_size=bucket).collect()), key=str)
    assert small == base
