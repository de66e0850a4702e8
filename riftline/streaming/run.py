"""Running sequential kernels: in batch over sorted partitions, in streams as checkpointed keyed state."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.operators.detectors import DETECTORS
from riftline.operators.segmenter import Segmenter

CHANGE_POINTS = "series_id string, cp long, score double, p double, detected_at long"


def in_order(series: DataFrame, start: Callable, schema: str) -> DataFrame:
    """start(series_id) gives (update, finish): rows of update(t, value) and finish(). A task reads its series in order and holds one kernel and one
    Arrow batch, never a whole series."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, update, finish = None, None, None
        for pdf in batches:
            rows = []
            for series_id, t, value in zip(pdf["series_id"], pdf["t"], pdf["value"], strict=True):
                if series_id != of:
                    if finish:
                        rows += [(of, *r) for r in finish()]
                    of, (update, finish) = series_id, start(series_id)
                rows += [(of, *r) for r in update(t, value)]
            yield pd.DataFrame(rows, columns=columns)
        if finish:
            yield pd.DataFrame([(of, *r) for r in finish()], columns=columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.repartition(parts, "series_id").sortWithinPartitions("series_id", "t").select("series_id", "t", "value").mapInPandas(run, schema)


def segment(series: DataFrame, **config) -> DataFrame:
    """Change points of each series by the incremental segmenter; series shorter than the prerun are segmented at their end."""

    def start(_):
        s = Segmenter(**config)

        def finish():
            before = len(s.change_points)
            s.flush()
            return s.change_points[before:]

        return (lambda t, v: s.update(v)), finish

    return in_order(series, start, CHANGE_POINTS)


def merged_profile(series: DataFrame, **config) -> DataFrame:
    """(series_id, split, score): the merged profile of the points that the segmenter holds at the end of a series."""

    def start(_):
        s = Segmenter(**config)

        def update(t, v):
            s.update(v)
            return []

        def finish():
            s.flush()
            return s.merged_profile()

        return update, finish

    return in_order(series, start, "series_id string, split long, score double")


def detect(series: DataFrame, name: str, **config) -> DataFrame:
    """(series_id, cp, detected_at) of a classical detector."""

    def start(_):
        d = DETECTORS[name](**config)

        def update(t, v):
            at = d.update(v)
            return [] if at is None else [(at, t)]

        return update, lambda: []

    return in_order(series, start, "series_id string, cp long, detected_at long")


def segment_stream(points: DataFrame, latest_only: bool = False, **config) -> DataFrame:
    """points: a streaming (series_id, at, value). State is one pickled kernel per series, in the checkpointed state store. Rows of a micro-batch are taken in
    order of ``at``; results do not depend on how points fall into micro-batches. With latest_only, one update emits its newest change point only."""

    def run(key, frames, state):
        s = pickle.loads(state.get[0]) if state.exists else Segmenter(**config)
        found = []
        for value in pd.concat(list(frames)).sort_values("at", kind="stable")["value"].tolist():
            new = s.update(value)
            found += new[-1:] if latest_only else new
        state.update((pickle.dumps(s),))
        yield pd.DataFrame([(key[0], *r) for r in found], columns=["series_id", "cp", "score", "p", "detected_at"])

    return points.groupBy("series_id").applyInPandasWithState(run, CHANGE_POINTS, "kernel binary", "append", "NoTimeout")


def replay_events(spark: SparkSession, path: str, checkpoint: str | None = None, **config) -> DataFrame:
    """The events table as a stream, to its end; its change points as a table in the shared folder."""
    rows = spark.read.parquet(path)
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    folder, _, name = path.rstrip("/").rpartition("/")
    one_file = [f for f in rows.inputFiles() if f.endswith(f"/{name}")]  # a stream reads folders
    points = (reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(path)).where("value IS NOT NULL")
    points = points.select(F.col("event_type").alias("series_id"), F.struct("ts", "event_id").alias("_o"), "value").select("series_id", F.concat_ws("|", F.date_format("_o.ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("_o.event_id").cast("string"), 20, "0")).alias("at"), "value")
    base = checkpoint or f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    query = segment_stream(points, **config).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(CHANGE_POINTS).parquet(f"{base}/out")


def _shared(spark: SparkSession) -> str:
    """The shared folder; in local mode, where one machine does all, a folder of its own if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="riftline-")
    return folder.rstrip("/")
