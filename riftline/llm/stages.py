"""The stages of the corpus pipeline. Each works on all rows of its docs; empty tables give empty tables, other columns are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm import jaccard, langid, mixing, packing, pii
from riftline.llm.common import Scratch, release, table, written

#: Runs of rows, of 4 KB each, that are broadcast; more are joined by shuffling.
BROADCAST_RUNS = 1 << 13
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells. It learns from the labelled rows that the query op6 learns from."""
    model = langid.train(docs.where(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))))
    return langid.predict(docs.select(*COLUMNS), model).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest id, an id before none; of rows that repeat an id, one.

    Rows have keys of their own here, since ids may repeat or be null: their place in the files, for a plain table, which each reading
    finds in the same order. Other inputs are written first. Documents without text are components of their own and stay.
    """
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    rows = (docs if plain else written(docs, "rows")).select(F.monotonically_increasing_id().alias("row"), *COLUMNS)
    found = jaccard.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*COLUMNS).alias("h"), "row")
    members = rows.select("row", order.alias("order")).join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    kept = members.groupBy("component_id").agg(F.min("order").alias("first")).select((F.col("first.row") + 1).alias("row"))
    # One bit for each row of a run of 32,768 rows, so that texts are not shuffled to find out which stay.
    runs = kept.groupBy(F.bitmap_bucket_number("row").alias("run")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))
    runs = written(runs, "kept")
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs.hint("merge")
    at = F.bitmap_bit_position(F.col("row") + 1)
    byte = F.conv(F.hex(F.substr("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    stays = F.pmod(F.expr("shiftright(_byte, cast(_at % 8 AS int))"), F.lit(2)) == 1
    met = rows.withColumn("run", F.bitmap_bucket_number(F.col("row") + 1)).join(runs, "run").withColumns({"_at": at, "_byte": byte})
    return met.where(stays).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII replaced by surrogates; n_chars follows the text."""
    out = pii.surrogates(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; null texts have no words and so follow their source's draw alone."""
    return mixing.expand(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents; a null or empty text is its end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("pii", private), ("mix", mix), ("pack", pack)]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of written tables, only those that it still reads are left."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since = len(Scratch.kept)
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
            path = Scratch.kept.pop()
            release(spark, since - (before is not None))
            Scratch.kept.append(path)
            before = path
    return docs
