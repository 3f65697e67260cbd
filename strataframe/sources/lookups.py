"""The lookup table that gives a sample its place and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from strataframe.functions.scalar import parse_timestamp
from strataframe.schema import LOOKUP_KEY
from strataframe.sources.files import header, ingest_csv

LOOKUP_COLUMNS = ("location", "timestamp", "lat", "lon")


def load_lookup(spark: SparkSession, path, location_col: str, key: str = LOOKUP_KEY) -> DataFrame:
    """Headed CSV with a float key, a location id under `location_col`, a timestamp text, lat, lon.

    Columns are taken by name, so their order in the file does not matter. Short rows, values that
    are no numbers, times that do not parse and fractional locations stop the job; empty fields are null.
    """
    numbers = {key, location_col, "lat", "lon"}
    fields = [T.StructField(c, T.DoubleType() if c in numbers else T.StringType()) for c in header(spark, path)]
    raw = ingest_csv(spark, path, T.StructType(fields))
    place, time = F.col(location_col), parse_timestamp(F.col("timestamp"))
    whole = F.when(place != F.floor(place), F.raise_error(F.concat(F.lit("fractional location "), place.cast("string")))).otherwise(place)
    known = F.when(F.col("timestamp").isNotNull() & time.isNull(), F.raise_error(F.concat(F.lit("no time: "), F.col("timestamp")))).otherwise(time)
    return raw.select(key, whole.cast("long").alias("location"), known.alias("timestamp"), "lat", "lon")
