"""Mixing sources to target weights: rates from token totals, whole copies plus one hash-seeded Bernoulli copy.

Native: DataFrame functions only. The only rows that leave a task are (source, sum) partial sums and the thin
(doc_id, source, size) rows. The table of sources has one row per source and is written first, so its size is known: below
``spark.sql.autoBroadcastJoinThreshold`` Spark broadcasts it and texts do not shuffle; otherwise it sort-merge joins, splitting hot sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.llm.common import WORD, table, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def document_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) by water filling.

    Sources are ranked by code point, null last; rank r weighs ``weights[r % len(weights)]``. A target is
    ``level * weight``, stopped at ``max_repeats * source_size``; the level is the one at which targets sum to all
    sizes. Ordered by cap / weight, the capped sources are a prefix, so the level has a closed form.
    """
    whole = Window.partitionBy()
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank").rowsBetween(0, Window.unboundedFollowing)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("source_rank", F.row_number().over(rank) - 1)
        .withColumn("weight", pick.cast("long"))
        .withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(fill))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))).over(whole)["level"])
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a keyed MD5; the same on every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """All columns of docs plus size, source_size, target and copies.

    ``copies`` is floor(rate) plus one with probability rate - floor(rate), where rate = target / source_size.
    Null texts have size 0; a null source is a source of its own, ranked last; a source without words has target 0
    and no copies. Rows that share a doc_id share their draw. An empty table gives an empty result.
    """
    sized = docs.withColumn("size", document_size(F.col("text")))
    targets = written(source_targets(sized.select("source", "size"), weights, max_repeats).withColumnRenamed("source", "target_source"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (uniform(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return (
        sized.join(targets, sized["source"].eqNullSafe(targets["target_source"])).drop("target_source")
        .withColumn("copies", F.floor(rate).cast("long") + extra)
    )


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document ``copies`` times, with the given columns."""
    repeated = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*columns)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM sized GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(r % 3 + 1)::INT] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM src
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size,
    least(cap::DOUBLE, (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, r LIMIT 1) * weight) AS target FROM l
), d AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM d
"""
