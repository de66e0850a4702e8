"""Language identification by prediction by partial matching.

For each language a byte-context tree of orders 0 to ORDER is counted on labelled documents, and each (context, byte) has its exact code
length: the byte's share where it was seen in the longest known context, else that context's escape and the next shorter context,
down to a uniform byte (escape method C). The statistics are then frozen. Contexts are of real bytes, exact in sorted tables of those seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.common import table

#: Longest context in bytes; with its byte it fits a 64-bit number.
ORDER = 5
#: Bounds of the labelled sample, in expectation: documents of a language, and bytes of all languages, each with an equal share.
TRAIN_DOCS, TRAIN_BYTES = 3000, 24 << 20
#: Languages that a model may tell apart; more raise an error.
MAX_LANGUAGES = 4096
CHUNK = 1 << 20
#: Code lengths that a worker remembers.
REMEMBERED = 1 << 22
#: The byte before a text.
PAD = 10
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts in one array, and where each text starts; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def grams(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each byte, as the lowest eight bits, under the ORDER bytes before it. Before the places in first, where texts begin, stands PAD."""
    out = data.astype(np.int64)
    for back in range(1, ORDER + 1):
        shifted = np.full(len(data), PAD, np.int64)
        shifted[back:] = data[: max(0, len(data) - back)]
        for k in range(back):
            at = first + k
            shifted[at[at < len(data)]] = PAD
        out |= shifted << (8 * back)
    return out


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked are in the sorted keys, and the values of those that are."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.float32)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at]


class Tree:
    """The frozen contexts of one language: of each order, bits of the bytes seen and of the escapes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.seen, self.escape = [], []
        for order in range(ORDER + 1):
            pair, at = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(at, weights=n, minlength=len(pair))
            context, of = np.unique(pair >> 8, return_inverse=True)
            total, distinct = np.bincount(of, weights=count, minlength=len(context)), np.bincount(of, minlength=len(context))
            self.seen.append((pair, -np.log2(count / (total + distinct)[of]).astype(np.float32)))
            self.escape.append((context, -np.log2(distinct / (total + distinct)).astype(np.float32)))


class Model:
    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees

    def __getstate__(self):
        return self.languages, self.trees

    def __setstate__(self, state):
        self.languages, self.trees = state

    def code_lengths(self, asked: np.ndarray, order: int = ORDER) -> np.ndarray:
        """(gram, language): bits of the last byte of each gram after the others."""
        shorter, at = np.unique(asked & ((1 << 8 * order) - 1), return_inverse=True)
        below = self.code_lengths(shorter, order - 1)[at] if order else np.full((len(asked), len(self.trees)), 8, np.float32)
        for i, tree in enumerate(self.trees):
            known, bits = _found(*tree.seen[order], asked)
            open_, escape = _found(*tree.escape[order], asked >> 8)
            below[:, i] = np.where(known, bits, below[:, i] + np.where(open_, escape, 0))
        return below

    def remembered(self, gram: np.ndarray) -> np.ndarray:
        """code_lengths of grams that repeat, by a table of those met before."""
        if not hasattr(self, "keys"):
            self.bits = max(1, (REMEMBERED // max(4, len(self.trees))).bit_length() - 1)
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros((1 << self.bits, len(self.trees)), np.float32)
        slot = lambda g: ((g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        at = slot(gram)
        out, new = self.values[at], np.flatnonzero(self.keys[at] != gram)
        if len(new):
            fresh, of = np.unique(gram[new], return_inverse=True)
            made = self.code_lengths(fresh)
            out[new] = made[of]
            # Of grams that share a slot the last stays, in both arrays.
            slots, last = np.unique(slot(fresh)[::-1], return_index=True)
            self.keys[slots], self.values[slots] = fresh[::-1][last], made[::-1][last]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language, over all of its bytes."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        filled = np.flatnonzero(np.diff(offsets))
        starts = offsets[filled]
        for a in range(0, len(data), CHUNK):
            b = min(len(data), a + CHUNK)
            lead = max(0, a - ORDER)
            lo, hi = np.searchsorted(starts, lead, "left"), np.searchsorted(starts, b, "left")
            gram = grams(data[lead:b], starts[lo:hi] - lead)[a - lead :]
            k0 = np.searchsorted(starts, a, "right") - 1
            cuts = np.concatenate([[0], starts[k0 + 1 : hi] - a]).astype(np.int64)
            out[filled[k0:hi]] += np.add.reduceat(self.remembered(gram), cuts, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Model:
    """Count contexts of the documents given with text and lang, a sample of at most about max_docs of each language and max_bytes in all.

    The sample is the documents with the smallest hashes of their ids, so it is the same on every run. What comes to the
    driver are counts of contexts, no more than bytes of the sample.
    """
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], [])
    shares = {r["lang"]: min(1.0, max_docs / r["n"], max_bytes / len(languages) / max(1, r["bytes"])) for r in sizes}
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, shares[k])])
    sample = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")])
    names = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            data, offsets = _bytes_of(batch.column(0))
            for i, lang in enumerate(batch.column(1).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                held.setdefault(names[lang], []).append(grams(text, np.zeros(1, np.int64)))
                size += len(text)
                if size > 4 * CHUNK:
                    yield from summed(held)
                    size = 0
        yield from summed(held)

    def summed(held):
        for k, codes in held.items():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            for a in range(0, len(code), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code[a : a + (1 << 16)]), k)), pa.array(code[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], names=["k", "gram", "n"])
        held.clear()

    rows = sample.select("text", "lang").mapInArrow(count, "k long, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).toArrow()
    k, gram, n = (rows.column(c).to_numpy() for c in ("k", "gram", "n"))
    return Model(languages, [Tree(gram[k == i], n[k == i]) for i in range(len(languages))])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs plus lang_pred and score.

    Every byte of the text counts. ``score`` is the share of the best language when code lengths are read as probabilities.
    A text that is null or has no letter, or any text when no language was learned, gives ``und`` and score 0. Ties go to
    the first language by name. Columns named lang_pred or score are replaced; repeated rows are scored alike.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(model)  # at most about max_bytes contexts
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = frozen.value
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            names, scores = [], []
            bits = m.score(*_bytes_of(texts)) if m.languages else None
            for i, text in enumerate(texts):
                if not m.languages or not any(map(str.isalpha, text.as_py() or "")):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    best = int(bits[i].argmin())
                    names.append(m.languages[best])
                    scores.append(float(1 / np.exp2(np.maximum(bits[i][best] - bits[i], -1000)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*columns).mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
