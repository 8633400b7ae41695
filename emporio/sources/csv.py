"""A1/A2: header CSV sources read with fixed schemas (no inference).

The reader is lazy: nothing is scanned until a plan that uses the frame
runs, and Catalyst prunes columns a plan does not need.  Quotes inside
a quoted field are doubled.  Columns are taken by the header's names, in
any order; a row that does not fit the schema stops the read instead of
shifting its values.  Only files whose text fields may hold line breaks
are read as one piece each (keep such sources as many files); all others
are split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql.types import StructType

from .schemas import SOURCES

#: Sources with free text, which may hold line breaks inside quotes.
MULTILINE = {"reviews"}


def load_source(spark: SparkSession, base: str, name: str, file_name: str | None = None) -> DataFrame:
    schema = SOURCES[name]
    path = f"{base.rstrip('/')}/{file_name or name + '.csv'}"
    reader = (spark.read.option("header", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"')
              .option("multiLine", name in MULTILINE).option("timestampFormat", "yyyy-MM-dd HH:mm:ss"))
    # the header's order (one line is read), with the fixed types
    given = [c.strip() for c in reader.option("inferSchema", False).csv(path).columns]
    if sorted(given) != sorted(schema.names):
        raise ValueError(f"{path}: columns {given}, expected {schema.names}")
    return reader.schema(StructType([schema[c] for c in given])).csv(path).select(*schema.names)


def load_orders(spark, base, file_name=None):
    return load_source(spark, base, "orders", file_name)


def load_order_items(spark, base, file_name=None):
    return load_source(spark, base, "order_items", file_name)


def load_customers(spark, base, file_name=None):
    return load_source(spark, base, "customers", file_name)


def load_products(spark, base, file_name=None):
    return load_source(spark, base, "products", file_name)


def load_sellers(spark, base, file_name=None):
    return load_source(spark, base, "sellers", file_name)


def load_payments(spark, base, file_name=None):
    return load_source(spark, base, "payments", file_name)


def load_reviews(spark, base, file_name=None):
    return load_source(spark, base, "reviews", file_name)


def load_geolocation(spark, base, file_name=None):
    return load_source(spark, base, "geolocation", file_name)


def load_categories(spark, base, file_name=None):
    return load_source(spark, base, "categories", file_name)


def load_all_sources(spark: SparkSession, base: str,
                     file_names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """A2: dict of lazy readers keyed by source name."""
    file_names = file_names or {}
    return {name: load_source(spark, base, name, file_names.get(name)) for name in SOURCES}
