"""Cost-balanced packing of tokenized documents into fixed-length sequences.

One pass, no shuffle: a task tokenizes the rows of its partition, gathers a window of whole documents and packs it.
Within a window there are exactly ``tokens // capacity`` sequences. Pieces go in descending length to the sequence of
lowest cost (linear plus quadratic attention cost) that has room for them; what fits nowhere is cut to fill the gaps,
so that every sequence of a window is full. Tokens left over open the next window. The last ones of a partition are cut
into sequences whose lengths are powers of two, which need no padding. A task holds one window, whatever its input.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftline.llm.common import table

END_ID = 2
CAPACITY = 4096
#: Words of which the ids are remembered by a Python worker, at about 150 bytes each.
CACHE_WORDS = 1_000_000

#: Characters for which lower-casing and word boundaries are the same in Python and in the tokenizer's normalizer.
_SIMPLE = re.compile(r"[\t\n\r\x20-\x7e¡-įĲ-ňŊ-ž]*")
_LETTER = "a-zªµºß-öø-ÿĀ-ſ"
_PIECE = re.compile(rf"[{_LETTER}]++|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼½¾]|[^\s{_LETTER}0-9²³¹¼½¾]++")


class WordBpe:
    """Ids of whole texts, by a memo of words. Texts with rare characters go to the tokenizer itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)

    def _learn(self, words: list[str]) -> None:
        n = len(self.index)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words):
            raise ValueError("the tokenizer does not mark the end of each word")
        used = int(self.start[n])
        while len(self.flat) < used + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.start) < n + len(words) + 1:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[used : used + len(ids)] = ids
        self.start[n + 1 : n + len(words) + 1] = used + last
        for i, word in enumerate(words, n):
            self.index[word] = i

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with END_ID last."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        pieces = [_PIECE.findall(x.lower()) if _SIMPLE.fullmatch(x) and "<|" not in x else None for x in texts]
        known = self.index
        new = [w for w in {w for p in pieces if p for w in p} if w not in known]
        if new:
            self._learn(new)
        out = []
        for text, p in zip(texts, pieces, strict=True):
            if p is None:
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            elif p:
                at = np.fromiter(map(known.__getitem__, p), np.int64, len(p))
                start = self.start[at]
                length = self.start[at + 1] - start
                to = np.cumsum(length)
                ids = self.flat[np.arange(to[-1]) + np.repeat(start - to + length, length)]
            else:
                ids = np.empty(0, np.uint32)
            out.append(np.append(ids, np.uint32(END_ID)))
        return out


_WORKER: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One encoder per Python worker and file."""
    if path not in _WORKER:
        _WORKER[path] = WordBpe(path)
    return _WORKER[path]


def balance(lengths: np.ndarray, n: int, capacity: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """n full sequences as lists of (piece, start, length), and what is left as (piece, start).

    Needs ``n * capacity <= sum(lengths)`` and no length above capacity.
    """
    room, cost = np.full(n, capacity), np.zeros(n)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    rest: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = int(np.where(room >= size, cost, np.inf).argmin())
        if room[at] < size:
            rest.append(i)
            continue
        held[at].append((i, 0, size))
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size
    left = [(i, 0) for i in rest]
    for at in np.lexsort((cost, room == 0)).tolist():
        while room[at] and left:
            i, start = left.pop(0)
            size = min(int(room[at]), int(lengths[i]) - start)
            held[at].append((i, start, size))
            room[at] -= size
            if start + size < lengths[i]:
                left.insert(0, (i, start + size))
    return held, left


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, window_sequences: int = 128, linear: float = 1.0, quadratic: float = 1.0 / 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    docs needs doc_id and text; other columns are ignored. A null or empty text is the single END_ID. Rows that repeat a
    doc_id are packed each on its own. An empty table gives no rows. Documents above capacity are first cut into
    full sequences and a remainder. ``with_ids`` adds the token ids of each piece. Sequence ids carry the
    partition in their upper bits; with the same files and splits, reruns agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        following = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        tokens = 0

        def emit(sequences):
            nonlocal following
            rows = []
            for pieces in sequences:
                offset = 0
                for doc, start, ids, total in pieces:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, following, offset) + ((ids.tolist(),) if with_ids else ()))
                    offset += len(ids)
                following += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids, strict=True)], names=names)

        def full():
            """Pack what is held into full sequences; keep what is left."""
            nonlocal held, tokens
            n = tokens // capacity
            sequences, left = balance(np.array([len(x[2]) for x in held]), n, capacity, linear, quadratic)
            done = [[(held[i][0], held[i][1] + at, held[i][2][at : at + size], held[i][3]) for i, at, size in s] for s in sequences]
            held = [(held[i][0], held[i][1] + at, held[i][2][at:], held[i][3]) for i, at in left]
            tokens -= n * capacity
            return emit(done)

        for batch in batches:
            names_in = batch.schema.names
            ids_in, texts = batch.column(names_in.index("doc_id")).to_pylist(), batch.column(names_in.index("text"))
            for k in range(0, len(ids_in), 64):
                for doc, ids in zip(ids_in[k : k + 64], encode([x or "" for x in texts.slice(k, 64).to_pylist()]), strict=True):
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        held.append((doc, start, part, len(ids)))
                        tokens += len(part)
                    while tokens >= window_sequences * capacity:
                        yield full()
        if tokens >= capacity:
            yield full()
        sequences = []
        while tokens:
            size, pieces = 1 << (tokens.bit_length() - 1), []
            tokens -= size
            while size:
                doc, start, ids, total = held.pop(0)
                pieces.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    held.insert(0, (doc, start + size, ids[size:], total))
                size -= len(pieces[-1][2])
            sequences.append(pieces)
        if sequences:
            yield emit(sequences)

    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    names = T.StructType.fromDDL(schema).names
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
