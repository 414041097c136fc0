"""Population microdata: CSV scan, cleaning and the compressed columnar copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage import config

COLUMNS = ["AGEP", "SEX", "SCHL", "PINCP", "ST", "RAC1P", "MAR", "PWGTP"]
POPULATION = T.StructType(
    [T.StructField(c, T.FloatType() if c == "PINCP" else T.IntegerType()) for c in COLUMNS]
)


def read_microdata_csv(spark: SparkSession, path: str) -> DataFrame:
    """The eight columns of interest from a headed CSV of any width.

    Columns are named by the header, never inferred: everything is read as text
    and cast, so unused columns are pruned in the parser.
    """
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return header.select(*[F.col(c).try_cast("double").alias(c) for c in COLUMNS])


def clean_population(raw: DataFrame) -> DataFrame:
    """Adults with an age and a weight, in the narrow types of the stored copy."""
    lo, hi = config.ADULT_AGES
    extra = [c for c in raw.columns if c not in COLUMNS]
    kept = raw.dropna(subset=["AGEP", "PWGTP"]).where(F.col("AGEP").between(lo, hi))
    income = F.when(~F.isnan(F.col("PINCP").cast("double")), F.col("PINCP")).cast("float")
    return kept.select(
        *extra, *[income.alias(c) if c == "PINCP" else F.col(c).cast("int").alias(c) for c in COLUMNS]
    )


def write_population(population: DataFrame, path: str) -> None:
    population.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_population(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POPULATION).parquet(path)
