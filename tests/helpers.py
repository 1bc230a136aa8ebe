"""Small tables for tests."""

from datetime import datetime, timedelta

DAY = timedelta(days=1)
T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)
