"""Exact Jaccard join of documents on word shingles, and its connected components.

Two sets that link share an element of their prefixes: the first n - ceil(t n) + 1 elements in one global order, which puts elements
rare in the corpus first (counted in a table of fixed size). Let ``rem`` be the number of elements of a set from an element on. At the first
common element of two sets, both have ``rem`` no less than the overlap that a link needs; so a pair is compared only at keys where that holds.

Identical sets are one node. The result is components, so pairs of nodes already connected are skipped. First a star: each node is
compared with one node, the pivot that it shares most keys with. A key's pivot in a size band is the node with the fewest rarer elements: the original
among its copies. Then the rest, exactly: keys whose nodes are still in different components are dealt, by size band, in tiles
of bounded size. A tile finds by sizes, ``rem`` and bitmaps which of its nodes have a possible partner in another component, and sends on those nodes, not
pairs. Tiles with the same possible pairs are one. The texts of what is left come to their tiles, which intersect sorted arrays and send out
only links that join components. So no link between different texts is lost, and what a task sends grows with the rows it has read.

Sets are compared as sets of 64-bit shingle hashes; nodes are named by a 64-bit fingerprint.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.common import Scratch, chunks, shuffle_partitions, table
from riftline.llm.shingles import K, bitmap, fingerprint, mix, shingle_sets

PERCENT = 80
#: Counters of the rarity order. Only the order of keys depends on them, never a result.
COUNTERS, BLOCK = 1 << 18, 1 << 12
BATCH_BYTES = 1 << 20
#: Nodes, and elements of their sets, of one block of a tile; members of a star that are compared in one group.
TILE, ELEMENTS, STAR = 4096, 1 << 21, 256
#: Bytes of packed keys that a task sorts at a time, on average.
SORTED = 16 << 20


def rarity(docs: DataFrame, k: int) -> np.ndarray:
    """A class for each counter, higher for higher counts: eighths of a power of two against the average."""

    def count(batches):
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, texts in chunks(batch.column(0), BATCH_BYTES):
                n += np.bincount((np.concatenate(shingle_sets(texts, k)) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if n.any():
            parts = [n[i : i + BLOCK].astype("<i8").tobytes() for i in range(0, COUNTERS, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[block] = held.get(block, 0) + np.frombuffer(counts, "<i8")
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "counts"])

    n = np.zeros(COUNTERS, np.int64)
    for row in docs.select("text").mapInArrow(count, "block int, counts binary").repartition(min(COUNTERS // BLOCK, shuffle_partitions(docs.sparkSession)), "block").mapInArrow(add, "block int, counts binary").collect():
        n[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], "<i8")
    return np.clip(np.round(8 * np.log2(np.maximum(1, n) / max(1.0, n.mean()))), -100, 100).astype(np.int8)


def prefix(s: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    n = len(s)
    length = n - -(-percent * n // 100) + 1 if n else 0
    kind = order[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
    return s[np.lexsort((s, kind))[:length]]


def signatures(docs: DataFrame, order: np.ndarray, k: int, percent: int) -> DataFrame:
    """(doc_id, n, node, keys, bitmap, text) of each row. Of rows of one node, a task keeps the text and the bitmap of the first only."""
    ranked = docs.sparkSession.sparkContext.broadcast(order)  # COUNTERS bytes
    schema = "doc_id long, n int, node long, keys binary, bitmap binary, text string"

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for at, texts in chunks(batch.column(1), BATCH_BYTES):
                sets = shingle_sets(texts, k)
                names = [fingerprint(s) for s in sets]
                fresh = []
                for node in names:
                    fresh.append(node not in seen)
                    seen.add(node)
                columns = (
                    (len(s) for s in sets), names, (prefix(s, ranked.value, percent).tobytes() for s in sets),
                    (bitmap(s) if new else None for s, new in zip(sets, fresh, strict=True)), (t.decode() if new else None for t, new in zip(texts, fresh, strict=True)),
                )
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string()), strict=True))], names=["doc_id", "n", "node", "keys", "bitmap", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


#: ``more``: other rows of this key were sent apart, so all of its rows stay.
_PAIR = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<i4"), ("rem", "<i4"), ("more", "?")])
_FLUSH = 1 << 20


def _cuts(key: np.ndarray) -> np.ndarray:
    """Where equal keys of a sorted array begin, and the end."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)


def _once(pairs: np.ndarray) -> np.ndarray:
    """Sorted by key and node, each once; ``more`` if any of them has it."""
    pairs = pairs[np.lexsort((~pairs["more"], pairs["node"], pairs["key"]))]
    return pairs[np.r_[True, (pairs["key"][1:] != pairs["key"][:-1]) | (pairs["node"][1:] != pairs["node"][:-1])]] if len(pairs) else pairs


def _possible(pairs: np.ndarray, percent: int) -> np.ndarray:
    """Of rows sorted by key, those that may have a partner among the rows of their key."""
    while len(pairs):
        cuts = _cuts(pairs["key"])
        size = np.diff(cuts)
        spread = lambda x, size=size: np.repeat(x, size)
        n, rem = pairs["n"].astype(np.int64), pairs["rem"].astype(np.int64)
        least = np.maximum(spread(np.minimum.reduceat(n, cuts[:-1])), -(-percent * n // 100))
        keep = (spread(size) > 1) & ((100 + percent) * rem >= percent * (n + least)) | spread(np.logical_or.reduceat(pairs["more"], cuts[:-1]))
        two = cuts[:-1][(size == 2)]
        need = percent * (n[two] + n[two + 1])
        bad = ((100 + percent) * np.minimum(rem[two], rem[two + 1]) < need) | (np.minimum(n[two], n[two + 1]) * 100 < np.maximum(n[two], n[two + 1]) * percent)
        bad &= ~(pairs["more"][two] | pairs["more"][two + 1])
        keep[two[bad]] = keep[two[bad] + 1] = False
        if keep.all():
            break
        pairs = pairs[keep]
    return pairs


def shared_keys(signed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(key, node, n, rem) of keys that two or more nodes have, without rows that can have no partner there. A row may come twice.

    Keys travel packed, in ranges of keys. A task first meets its own equal keys: of those only one row goes to the range,
    and the rest, known to be shared, goes on to any range. So a key of very many nodes sends one row a task.
    """
    size = signed.agg(F.sum(F.length("keys"))).first()[0] or 0
    parts = max(shuffle_partitions(signed.sparkSession), -(-size * _PAIR.itemsize // 8 // SORTED))
    ranges = 8 * parts
    names = ["bucket", "probe", "pairs"]

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            for node, n, own in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                keys = np.frombuffer(own.as_buffer(), "<u8")
                pairs = np.zeros(len(keys), _PAIR)
                pairs["key"], pairs["node"], pairs["n"], pairs["rem"] = keys, node, n, n - np.arange(len(keys))
                held.append(pairs)
                size += len(pairs)
                if size >= _FLUSH:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def send(held):
        pairs = _once(np.concatenate(held))
        cuts = _cuts(pairs["key"])
        shared = np.diff(cuts) > 1
        pairs["more"] = np.repeat(shared, np.diff(cuts))
        probes, known = pairs[cuts[:-1]], pairs[pairs["more"]]
        bucket = ((probes["key"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(ranges + 1))
        rows = [(i, True, probes[cuts[i] : cuts[i + 1]].tobytes()) for i in range(ranges) if cuts[i] < cuts[i + 1]]
        rows += [(int(known["node"][i] % ranges), False, known[i : i + 1024].tobytes()) for i in range(0, len(known), 1024)]
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256], strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=names)

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array(pairs["key"].view("<i8")), *(pa.array(np.ascontiguousarray(pairs[c])) for c in ("node", "n", "rem"))], names=["key", "node", "n", "rem"])

    def meet(batches):
        held = []
        for batch in batches:
            for probe, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                pairs = np.frombuffer(blob.as_buffer(), _PAIR)
                if probe:
                    held.append(pairs.copy())
                else:
                    yield out(pairs)
        if held:
            pairs = _possible(_once(np.concatenate(held)), percent)
            for i in range(0, len(pairs), 1 << 16):
                yield out(pairs[i : i + (1 << 16)])

    return signed.where("n > 0").select("node", "n", "keys").mapInArrow(deal, "bucket int, probe boolean, pairs binary").repartition(parts, "bucket").mapInArrow(meet, "key long, node long, n int, rem int")


def distinct_members(keys: DataFrame) -> DataFrame:
    """(key, node, n, rem, weight): of keys with the same nodes (by two 64-bit sums and their count), the first in the global order, with their number as weight.

    Two nodes share all of them, so their first common element is the one where ``rem`` is largest.
    """
    total = lambda seed: F.expr(f"bit_xor(xxhash64(node, {seed}))")
    members = keys.groupBy("key").agg(total(1).alias("x"), total(2).alias("y"), F.count("*").alias("m"), F.sum("rem").alias("rems")).where("m > 1")
    kept = members.groupBy("x", "y", "m").agg(F.max(F.struct("rems", "key")).alias("first"), F.count("*").alias("weight"))
    return keys.join(kept.select(F.col("first.key").alias("key"), "weight"), "key")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node that each node of a link reaches. Labels spread along links, and jump to their label's label."""
    both = scratch.written(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = scratch.written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = scratch.written(labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("next")), "labels")
        jump = spread.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = scratch.written(spread.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels


def node_texts(signed: DataFrame, met: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """(node, bitmap, text), one row for each node of met, bucketed by node so that no later join shuffles texts; and the table's name."""
    spark = signed.sparkSession

    def once(batches):
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for node in batch.column(0).to_pylist():
                fresh.append(node not in seen)
                seen.add(node)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    name, parts = f"riftline_texts_{uuid.uuid4().hex}", shuffle_partitions(spark)
    held = signed.where("n > 0 AND text IS NOT NULL").select("node", "bitmap", "text").join(met, "node", "left_semi")
    held.repartition(parts, "node").mapInArrow(once, "node long, bitmap binary, text string").write.bucketBy(parts, "node").option("compression", "zstd").option("path", scratch.path("texts")).saveAsTable(name)
    return spark.table(name), name


def _step(percent: int) -> float:
    """Width of a size band, as a logarithm: sizes that can link are in one band or in two neighbours."""
    return max(1e-6, 1.0001 * math.log(100 / percent))


def _band(percent: int):
    return F.floor(F.log(F.col("n").cast("double")) / _step(percent)).cast("int")


def _overlaps(rem, n, m, percent: int):
    """Whether a node of n elements, rem of them from a key on, can link with one of m elements of which that key is the first common one."""
    return rem * (100 + percent) >= (n + m) * percent


def star(keys: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each node the pivot that it shares most keys with, of those that it can link with."""
    banded = keys.withColumn("band", _band(percent))
    first = F.struct((F.col("rem") / F.col("n")).alias("central"), F.xxhash64("node").alias("h"), "node", "n", "rem")
    chosen = banded.groupBy("key", "band").agg(F.max(first).alias("p"))
    chosen = chosen.select("key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("p.node").alias("b"), F.col("p.n").alias("m"), F.col("p.rem").alias("m_rem"))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    met = banded.join(chosen, ["key", "band"]).where((F.col("node") != F.col("b")) & fits & _overlaps(F.col("rem"), F.col("n"), F.col("m"), percent) & _overlaps(F.col("m_rem"), F.col("m"), F.col("n"), percent))
    counted = met.groupBy(F.col("node").alias("a"), "b").agg(F.sum("weight").alias("weight"))
    return counted.groupBy("a").agg(F.max(F.struct("weight", "b")).alias("best")).select("a", "best.b")


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """Elements common to two sorted arrays."""
    if len(s) > len(t):
        s, t = t, s
    place = np.searchsorted(t, s)
    return int((t[np.minimum(place, len(t) - 1)] == s).sum())


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b), those that link, by intersecting the sorted arrays of their whole texts.

    The members of b are dealt in groups of about STAR, and b goes to each of them, so a hot b does not land in one task.
    """
    pairs = scratch.written(pairs, "pairs")
    heads = scratch.written(pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", F.ceil(F.col("n") / STAR).cast("int").alias("groups")), "heads")
    members = pairs.join(heads, "b").select("b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("a").alias("node"))
    first = heads.select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("role"), F.col("b").alias("node"))
    rows = members.unionByName(first).join(texts.select("node", "text"), "node").select("b", "part", "role", "node", "text")

    def run(batches):
        head = (None, np.empty(0, np.uint64))
        for batch in batches:
            b, role, node = (batch.column(c).to_pylist() for c in ("b", "role", "node"))
            found = []
            for at, chunk in chunks(batch.column("text"), BATCH_BYTES):
                for i, s in enumerate(shingle_sets(chunk, k), at):
                    if role[i] == 0:
                        head = (b[i], s)
                    elif head[0] == b[i]:
                        common = _common(s, head[1])
                        if 100 * common >= percent * (len(s) + len(head[1]) - common):
                            found.append((node[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "b", "part").sortWithinPartitions("b", "part", "role")
    return dealt.mapInArrow(run, "a long, b long")


class Tile:
    """The nodes of a key and cell, of one block or of two: their pairs that may link across components."""

    STRIP = 1 << 20

    def __init__(self, rows: list[tuple], bitmaps: list[bytes], blocks: tuple[int, int], percent: int):
        self.node, self.label, self.n, self.rem, self.role, self.own = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        self.bitmaps, self.two, self.percent = bitmaps, blocks[0] != blocks[1], percent

    def pairs(self):
        """(i, j, bound) arrays, by strips. Of two blocks, one node is of each. Each bitmap is folded to the narrower width of its pair."""
        by_width: dict[int, list[int]] = {}
        for i, b in enumerate(self.bitmaps):
            by_width.setdefault(len(b), []).append(i)
        bits = {w: np.frombuffer(b"".join(self.bitmaps[i] for i in at), np.uint64).reshape(len(at), -1) for w, at in by_width.items()}
        for w in by_width:
            for v in by_width:
                if v >= w:
                    y = bits[v]
                    while y.shape[1] > bits[w].shape[1]:
                        y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
                    yield from self._between(np.array(by_width[w]), bits[w], np.array(by_width[v]), y, v == w)

    def _between(self, at, x, other, y, same):
        p, strip = self.percent, max(1, self.STRIP // len(other))
        for lo in range(0, len(at), strip):
            one, two = at[lo : lo + strip][:, None], other[None, :]
            n, m = self.n[one], self.n[two]
            fits = (np.minimum(n, m) * 100 >= np.maximum(n, m) * p) & (self.label[one] != self.label[two]) & (self.role[one] + self.role[two] < 2)
            fits &= np.minimum(self.rem[one], self.rem[two]) * (100 + p) >= (n + m) * p
            if self.two:
                fits &= self.own[one] != self.own[two]
            if same:
                fits &= one < two
            i, j = np.nonzero(fits)
            size = max(1, (1 << 19) // x.shape[1])
            for k in range(0, len(i), size):
                r, c = i[k : k + size], j[k : k + size]
                a, b = x[lo + r], y[c]
                both = a & b
                n_a, n_b = n[r, 0], m[0, c]
                bound = np.minimum(n_a - np.bitwise_count(a ^ both).sum(1, dtype=np.int64), n_b - np.bitwise_count(b ^ both).sum(1, dtype=np.int64))
                ok = (100 + p) * bound >= p * (n_a + n_b)
                yield at[lo + r[ok]], other[c[ok]], bound[ok] / (n_a[ok] + n_b[ok])


_TILE = ("key", "cell", "i", "j")
_ROW = ("node", "label", "n", "rem", "role", "own")


def _tiles(batches, payloads):
    """(tile, rows, payloads) of each tile with several rows, from batches sorted by tile."""
    of, rows, data = None, [], []
    for batch in batches:
        lists = lambda names, batch=batch: zip(*(batch.column(c).to_pylist() for c in names), strict=True)
        for tile, row, payload in zip(lists(_TILE), lists(_ROW), payloads(batch), strict=True):
            if tile != of:
                if len(rows) > 1:
                    yield of, rows, data
                of, rows, data = tile, [], []
            rows.append(row)
            data.append(payload)
    if len(rows) > 1:
        yield of, rows, data


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), *_TILE).sortWithinPartitions(*_TILE)


def tiles(keys: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """keys (key, node, n, rem, label) dealt in tiles, with bitmaps; without tiles of one component and rows that can have no partner in theirs.

    The cell of a band holds its own nodes (role 0) and those of the next band (role 1). The nodes of a cell are dealt in blocks of about TILE nodes
    and ELEMENTS elements, and each two blocks meet in a tile.
    """
    cell = lambda band, role: F.struct(band.cast("int").alias("cell"), F.lit(role).alias("role"))
    rows = keys.withColumn("_c", F.explode(F.array(cell(_band(percent), 0), cell(_band(percent) - 1, 1)))).select("key", "_c.cell", "_c.role", "node", "label", "n", "rem")
    least = lambda of: F.greatest(of, F.col("n") * percent / 100)
    # Partners of a row are no smaller than its cell begins.
    rows = scratch.written(rows.where(_overlaps(F.col("rem"), F.col("n"), least(F.exp(F.col("cell") * _step(percent)) * (1 - 1e-6)), percent)), "cells")
    found = rows.groupBy("key", "cell").agg(F.count("*").alias("members"), F.sum("n").alias("elements"), F.min("n").alias("least_n"), F.min("role").alias("least"), F.min("label").alias("x"), F.max("label").alias("y"))
    blocks = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("elements") / ELEMENTS)).cast("int")
    mixed = scratch.written(found.where("least = 0 AND x != y").select("key", "cell", blocks.alias("blocks"), "least_n"), "mixed")
    held = rows.join(mixed, ["key", "cell"]).where(_overlaps(F.col("rem"), F.col("n"), least(F.col("least_n")), percent)).join(texts.select("node", "bitmap"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *_ROW, "bitmap")


def possible(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows of tiles that have a possible partner in another component, each tile with a hash of its possible pairs."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    names = (*_TILE, "pairs", *_ROW)

    def run(batches):
        out: list[tuple] = []
        for tile, rows, bitmaps in _tiles(batches, lambda b: b.column("bitmap").to_pylist()):
            t = Tile(rows, bitmaps, tile[2:], percent)
            some, name = np.zeros(len(rows), bool), np.uint64(0)
            for i, j, _ in t.pairs():
                some[i] = some[j] = True
                low, high = np.minimum(t.node[i], t.node[j]), np.maximum(t.node[i], t.node[j])
                name = name + mix(mix(low.astype(np.uint64)) + high.astype(np.uint64)).sum(dtype=np.uint64)
            out += [(*tile, int(name.astype(np.int64)), *rows[i]) for i in np.flatnonzero(some).tolist()]
            if len(out) > 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return _dealt(dealt).mapInArrow(run, "key long, cell int, i int, j int, pairs long, node long, label long, n int, rem int, role int, own int")


def across(open_keys: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join all components that share a link at open_keys (key, node, n, rem, label)."""
    left = scratch.written(possible(tiles(open_keys, texts, percent, scratch), percent), "possible")
    tile = F.struct(*_TILE)
    members = left.groupBy("pairs", *_TILE).agg(F.count("*").alias("members"))
    kept = members.groupBy("pairs", "members").agg(F.min(tile).alias("tile")).select("tile.*")
    kept = scratch.written(kept, "tiles")
    rows = left.join(kept, list(_TILE), "left_semi").join(texts.select("node", "text"), "node").select(*_TILE, *_ROW, "text")

    def sets(batch):
        for _, chunk in chunks(batch.column("text"), BATCH_BYTES):
            yield from shingle_sets(chunk, k)

    def run(batches):
        found: list[tuple[int, int]] = []
        for tile, rows, held in _tiles(batches, sets):
            t, up = Tile(rows, [bitmap(s) for s in held], tile[2:], percent), {}

            def root(x, up=up):
                while x in up:
                    x = up[x]
                return x

            for i, j, bound in t.pairs():
                order = np.lexsort((j, i, -bound))
                for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                    x, y = root(rows[a][1]), root(rows[b][1])
                    if x != y:
                        common = _common(held[a], held[b])
                        if 100 * common >= percent * (len(held[a]) + len(held[b]) - common):
                            up[max(x, y)] = min(x, y)
                            found.append((max(rows[a][0], rows[b][0]), min(rows[a][0], rows[b][0])))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return _dealt(rows).mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT, with_star: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are ignored).

    Words are runs of other than ASCII white space, with A-Z lower-cased. A document of fewer than k words has one shingle.
    Null and empty texts have no shingle, link with nothing and are their own component. Rows with equal texts link.
    Two documents link when 100 * intersection >= percent * union. An empty table gives no rows. Without the star the exact pass does all.
    """
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.written(signatures(docs, rarity(docs, k), k, percent), "signatures")
        keys = scratch.written(distinct_members(scratch.written(shared_keys(signed, percent, scratch).distinct(), "shared")), "keys")
        scratch.drop("shared")
        texts, texts_name = node_texts(signed, keys.select("node").distinct(), scratch)
        signed = scratch.written(signed.select("doc_id", "n", "node"), "nodes")
        scratch.drop("signatures")
        try:
            labels = components(verified(star(keys, percent) if with_star else star(keys, percent).limit(0), texts, k, percent, scratch), scratch)
            named = scratch.written(keys.join(labels, "node", "left").select("key", "node", "n", "rem", F.coalesce("label", "node").alias("label")), "named")
            mixed = scratch.written(named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key"), "mixed")
            more = scratch.written(across(named.join(mixed, "key", "left_semi"), texts, k, percent, scratch), "more")
        finally:
            docs.sparkSession.sql(f"DROP TABLE IF EXISTS {texts_name}")
            scratch.drop("texts")
        if not more.isEmpty():  # few: join those, then rename
            of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
            joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
            again = components(joined.where("a != b"), scratch)
            loose = again.join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_anti")
            labels = labels.join(again.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label")).unionByName(loose)

        classes = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"))
        least = scratch.written(labels.join(classes, "node"), "least")
        smallest = least.groupBy("label").agg(F.min("least_id").alias("smallest"))
        of_node = classes.join(least.join(smallest, "label").select("node", "smallest"), "node", "left").select("node", F.coalesce("smallest", "least_id").alias("component_id"))
        of_node = scratch.written(of_node, "classes")
        full = signed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
        out = full.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        return scratch.written(out, "components", keep=True)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same by a join on the shingles themselves.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingles FROM words),
elements AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least ON doc_id = a
"""
