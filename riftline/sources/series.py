"""Sources: tables and description files as series in long form (series_id, t, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_series(rows: DataFrame, key: str, order: list[str], value: str, on_null: str = "drop") -> DataFrame:
    """(series_id, t, value); t counts from 0 in the given order. on_null: 'drop' removes null and NaN values, 'error' fails on them."""
    v = F.col(value).cast("double")
    if on_null == "drop":
        rows = rows.where(v.isNotNull() & ~F.isnan(v))
    elif on_null == "error":
        v = F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit("null value in a series"))).otherwise(v)
    t = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1
    return rows.select(F.col(key).cast("string").alias("series_id"), t.alias("t"), v.alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_series(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")


def injected(series: DataFrame, period: int = 20) -> DataFrame:
    """The second half of each series damped, with a sine added: one known change point, cp = floor(n / 2)."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    v = F.when(F.col("t") * 2 >= n, 0.2 * F.col("value") + 50.0 * F.sin(2.0 * F.lit(3.141592653589793) * F.col("t") / period)).otherwise(F.col("value"))
    return series.select("series_id", "t", v.alias("value"))


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``name,window,cp1,cp2,...`` as (name, window_size, change_points)."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    cps = F.transform(F.filter(F.slice(parts, 3, 1 << 30), lambda x: x != ""), lambda x: x.cast("long"))
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(parts[0].alias("name"), parts[1].cast("int").alias("window_size"), cps.alias("change_points"))


def explode_series(compact: DataFrame) -> DataFrame:
    """(name, time_series array) to long form."""
    return compact.select(F.col("name").alias("series_id"), F.posexplode("time_series").alias("t", "value")).select("series_id", F.col("t").cast("long"), "value")


def select_series(catalogue: DataFrame, names: list[str]) -> DataFrame:
    return catalogue.where(F.col("name").isin(names)).orderBy("name")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files with list columns, read with a schema and parsed as JSON arrays."""
    schema = "dataset string, true_cps string, found_cps string, found_cps_dx string, f1_score double, covering_score double"
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return rows.withColumns({c: F.from_json(c, "array<bigint>") for c in ("true_cps", "found_cps", "found_cps_dx")})


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
