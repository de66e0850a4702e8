"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample turn each unit vector into a binary code. The code is split into substrings, each indexed in
buckets. Of two codes within Hamming radius r, at least one of m substrings differs in at most floor(r / m) bits, so probing each
substring's buckets up to that distance retrieves every code within the radius. The codes found are checked against r, and
their original vectors are reranked by cosine in double precision.

The radius is calibrated on the sample: the distance within which nearly all true neighbours of sampled queries lie there.
More rows only bring neighbours nearer. A query with too few candidates within it is searched again at twice the radius.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.llm.common import table, written

#: Bound of the sample that rotations and radius are learned on.
SAMPLE = 8192
BITS, SUBSTRING = 128, 16
TOP = 5
#: Vectors of one index block.
INDEX_ROWS = 1 << 14
RECALL = 0.985


def unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return normal(x)


def normal(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled by powers of two first, which changes no digit, so that no square over- or underflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of vectors that are not null, not zero, and have no null or non-finite component."""
    d = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))


class Codes:
    """Learned rotations (iterative quantization, from as many seeds as it takes for BITS) and a calibrated radius."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, top: int = TOP, recall: float = RECALL, steps: int = 15):
        dim = sample.shape[1]
        self.mean = sample.mean(0)
        x = sample - self.mean
        self.rotations = []
        for seed in range(-(-bits // dim)):
            r = np.linalg.qr(np.random.RandomState(seed).randn(dim, dim))[0]
            for _ in range(steps):
                u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
                r = (u @ vt).T
            self.rotations.append(r)
        self.bits = bits
        self.m = bits // SUBSTRING
        q = sample[: min(256, len(sample))]
        near = q @ sample.T
        near[np.arange(len(q)), np.arange(len(q))] = -2
        take = min(top, max(1, len(sample) - 1))
        best = np.argpartition(-near, take - 1, axis=1)[:, :take]
        code = self.encode(sample)
        distance = hamming(code[: len(q), None], code[best])
        self.radius = int(np.quantile(distance, recall, method="higher"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, m) of 16-bit substrings."""
        on = np.concatenate([(x - self.mean) @ r > 0 for r in self.rotations], axis=1)[:, : self.bits]
        return np.packbits(on, axis=1).view(">u2").astype(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Index:
    """Buckets of each substring over one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = _words(codes)
        self.rows, self.starts, self.keys, self.bucket = [], [], [], []
        for s in codes.T:
            self.rows.append(np.argsort(s, kind="stable"))
            self.starts.append(np.searchsorted(s[self.rows[-1]], np.arange((1 << SUBSTRING) + 1)))
            keys, bucket = np.unique(s, return_inverse=True)
            self.keys.append(keys)
            self.bucket.append(bucket.ravel())

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The places of all codes within the radius. Where the masks outnumber the buckets that hold a code, those buckets are gone through in their place."""
        hit = np.zeros(len(self.codes), bool)
        most = min(SUBSTRING, radius // len(code))
        flips = _flips(most)
        for value, rows, starts, keys, bucket in zip(code, self.rows, self.starts, self.keys, self.bucket, strict=True):
            if 4 * len(flips) > len(keys):
                hit |= (np.bitwise_count(keys ^ value) <= most).take(bucket)
                continue
            probe = flips ^ value
            lo = starts[probe]
            n = starts[probe.astype(np.int64) + 1] - lo
            ends = np.cumsum(n)
            hit[rows[np.arange(ends[-1]) + np.repeat(lo - ends + n, n)]] = True
        at = np.flatnonzero(hit)
        apart = np.zeros(len(at), np.uint8)
        for held, word in zip(self.words, _words(code[None]), strict=True):
            apart += np.bitwise_count(held.take(at) ^ word)
        return at[apart <= radius]


def _words(codes: np.ndarray) -> list[np.ndarray]:
    """Columns of codes, as many substrings together as fill a machine word."""
    size = next(k for k in (4, 2, 1) if codes.shape[1] % k == 0)
    return list(np.ascontiguousarray(np.ascontiguousarray(codes).view(f"u{2 * size}").T))


_FLIPS: dict[int, np.ndarray] = {}


def _flips(r: int) -> np.ndarray:
    """All 16-bit masks with at most r bits."""
    if r not in _FLIPS:
        every = np.arange(1 << SUBSTRING, dtype=np.uint16)
        _FLIPS[r] = every[np.bitwise_count(every) <= r]
    return _FLIPS[r]


SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(queries: DataFrame, vectors: DataFrame, top: int = TOP, sample_rows: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the top nearest found of each query among all vectors of its length but its own id.

    Both inputs are (id, vec) of valid(). Every vector is indexed, by lengths apart. Vectors are dealt into blocks by hash; a task builds the index of
    a block once and all queries pass it, and what leaves it is at most top rows per query. Ties go to the smaller id, rows that repeat an id and a
    vector count once. No vectors: no rows.
    """
    found = vectors.sparkSession.createDataFrame([], SCHEMA)
    for r in sorted(vectors.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()):
        own = F.size("vec") == r["dim"]
        found = found.union(_search(queries.where(own), vectors.where(own), r["dim"], r["n"], top, sample_rows))
    return found


def _search(asked: DataFrame, vectors: DataFrame, dim: int, n: int, top: int, sample_rows: int) -> DataFrame:
    """search() over n vectors, all of length dim."""
    spark = vectors.sparkSession
    share = min(1.0, 0.9 * sample_rows / n)
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(F.xxhash64("id")).limit(sample_rows).collect()
    sample = normal(np.array([r["vec"] for r in picked], float).reshape(-1, dim)) if picked else np.empty((0, dim))
    if len(sample) < 2 * dim:
        sample = np.vstack([sample, normal(np.random.RandomState(0).randn(2 * dim, dim))])
    codes = spark.sparkContext.broadcast(Codes(sample, top=top))  # bounded by dim and BITS
    blocks = -(-n // INDEX_ROWS)
    index = vectors.withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("role", F.lit(0))
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("role", F.lit(1))

    def find(ids, x, single, built, ask_ids, y, coded) -> list[tuple[int, int, float]]:
        found = []
        for q, v, c in zip(ask_ids, y, coded, strict=True):
            radius, want = codes.value.radius, min(top, len(ids) - int((ids == q).any()))
            while True:
                at = built.within(c, radius)
                at = at[ids[at] != q]
                if len(at) >= want or radius >= codes.value.bits:
                    break
                radius = min(codes.value.bits, 2 * radius)
            if len(at) > top:  # products in single precision leave out what is not among the top by more than their error
                rough = single.take(at, 0) @ v.astype(np.float32)
                at = at[rough >= np.partition(rough, -top)[-top] - (dim + 4) * 2.0**-21]
            score = (x[at] * v).sum(1)
            for k in np.lexsort((ids[at], -score))[:top]:
                found.append((q, int(ids[at][k]), float(score[k])))
        return found

    def run(batches):
        of, ids, held, built = None, [], [], None
        for batch in batches:
            i, role = (batch.column(c).to_numpy() for c in ("i", "role"))
            found = []
            cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(role) != 0)) + 1).tolist(), len(i)]
            for a, b in itertools.pairwise(cuts):
                if i[a] != of:
                    of, ids, held, built = i[a], [], [], None
                x = unit(batch.column("vec").slice(a, b - a), dim)
                own = batch.column("id").slice(a, b - a).to_numpy()
                if role[a] == 0:
                    ids.append(own)
                    held.append(x)
                elif ids:
                    if built is None:
                        all_ids, rows = np.concatenate(ids), np.concatenate(held)
                        held = []
                        single, built = rows.astype(np.float32), Index(codes.value.encode(rows))
                    found += find(all_ids, rows, single, built, own.tolist(), x, codes.value.encode(x))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], names=["query_id", "vec_id", "score"])

    columns = ["i", "role", "id", "vec"]
    met = index.select(*columns).union(asked.select(*columns)).repartition(blocks, "i").sortWithinPartitions("i", "role")
    near = met.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 50, against all."""
    vectors = written(valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return search(vectors.where("id % 50 = 0"), vectors)
