import pytest
from pyspark.sql import functions as F

from edgeloom.functions import keyfilter


def test_no_key_is_lost(spark):
    rows = spark.range(20000).select(F.col("id").cast("int").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("b"), F.concat(F.lit("x"), F.col("id") % 5).alias("c"))
    keys = rows.filter("a % 50 = 3").select(F.col("a").cast("bigint").alias("k"), "b", "c")
    cols = [F.col("a"), F.col("b"), F.col("c")]
    hit, rest = keyfilter.maybe_among(rows, cols, keys), keyfilter.maybe_among(rows, cols, keys, negate=True)
    assert hit.columns == rows.columns and hit.filter("a % 50 = 3").count() == 400
    assert hit.count() < 450 and hit.count() + rest.count() == 20000
    assert keyfilter.maybe_among(rows, cols, keys.limit(0)).count() == 0
    few = keyfilter.with_maybe(rows, cols, keys, bits=1 << 8)  # a filter that is too small tells more rows true, and loses none
    assert few.filter("maybe AND a % 50 = 3").count() == 400 and few.filter("maybe").count() > 10000
    with pytest.raises(ValueError):
        keyfilter.maybe_among(rows, [F.col("c")], keys.select("k"))
