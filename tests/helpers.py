"""Small builders shared by the record-control tests."""

from datetime import date
from decimal import Decimal


def d(text):
    return date.fromisoformat(text)


def m(value):
    return None if value is None else Decimal(str(value))


def frame(spark, schema, rows):
    """Rows as dicts; absent columns are NULL."""
    names = [part.strip().split(" ")[0] for part in schema.replace("decimal(18,2)", "decimal").replace("decimal(28,4)", "decimal").split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def shuffled(df, way):
    if way == "reversed":
        from pyspark.sql import functions as F
        return df.orderBy(F.desc(df.columns[0]))
    return df.repartition(7) if way == "spread" else df


def counted(spark, schema, rows):
    """A frame and a counter of the rows that its readers have taken from it."""
    reads = spark.sparkContext.accumulator(0)

    def noted(row):
        reads.add(1)
        return row

    given = frame(spark, schema, rows)
    return spark.createDataFrame(given.rdd.map(noted), given.schema), reads
