"""Packing of documents into training windows by the sum-of-squares rule, online.

A document's ids (its tokens and an end id) are cut into full windows and a rest.
The rest goes to the fill level that makes the sum of squared counts of partially
filled windows smallest; an array holds the count of each level.  The windows that
are still open at the end of a task, or when they hold more than `open_ids` ids,
are joined end to end and cut anew, so that a task leaves less than one window;
that rest is stored in sequences of power-of-two lengths.  Hence no padding is
left, and memory doesn't grow with the input.  There is no shuffle: each task packs
what it reads, and sequence ids carry the task's number.

Defined results: null or empty text is a document of the end id alone; null
doc_ids stay null; repeated rows are packed each; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.llm.common import BATCH_BYTES, bounded_batches, slices, table, texts_of
from lanna.llm.tokens import WORD_BPE, encoder, vocabulary_path

WINDOW = 2048
END_ID = 1
OPEN_IDS = 4 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """The level array and the open windows: each a list of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, open_ids: int = OPEN_IDS):
        self.window, self.most = window, open_ids
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.held = 0

    def level(self, size: int) -> int:
        """The level whose change of the sum of squares is smallest; the fullest of equal ones, 0 for a new window."""
        window, count = self.window, self.count
        after = 2 * count[size:] + 1
        after[-1] = 0  # a full window is no partial one
        change = after + (1 - 2 * count[: window - size + 1])
        change[1:][count[1 : window - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = after[0]
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, piece: tuple) -> Iterator[list[tuple]]:
        """Places a piece; gives the windows that this completes."""
        size = len(piece[2])
        if size == self.window:
            yield [piece]
            return
        at = self.level(size)
        pieces = self.open[at].pop() if at else []
        self.count[at] -= at > 0
        pieces.append(piece)
        if at + size == self.window:
            self.held -= at
            yield pieces
            return
        self.open[at + size].append(pieces)
        self.count[at + size] += 1
        self.held += size
        if self.held > self.most:
            yield from self.join()

    def join(self) -> Iterator[list[tuple]]:
        """Cuts the open windows' ids anew into full windows; what is left stays as one open window."""
        rest = [p for level in reversed(self.open) for pieces in level for p in pieces]
        self.open, self.held = [[] for _ in self.open], 0
        self.count[:] = 0
        left: list[tuple] = []
        room = self.window
        for doc, start, ids, total in rest:
            while len(ids) >= room:
                yield [*left, (doc, start, ids[:room], total)]
                start, ids, left, room = start + room, ids[room:], [], self.window
            if len(ids):
                left.append((doc, start, ids, total))
                room -= len(ids)
        if left:
            self.held = self.window - room
            self.open[self.held].append(left)
            self.count[self.held] = 1

    def close(self) -> Iterator[list[tuple]]:
        """Everything that is open: full windows, then sequences of falling power-of-two lengths."""
        yield from self.join()
        if not self.held:
            return
        (left,) = self.open[self.held]
        for bit in reversed(range(self.held.bit_length())):
            size, taken = self.held & (1 << bit), []
            while size:
                doc, start, ids, total = left[0]
                taken.append((doc, start, ids[:size], total))
                left[:1] = [(doc, start + size, ids[size:], total)] if len(ids) > size else []
                size -= min(size, len(ids))
            if taken:
                yield taken


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, window: int, open_ids: int) -> Iterator[pa.RecordBatch]:
    enc, packer = encoder(path, False), SumOfSquares(window, open_ids)
    number = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []

    def put(sequences: Iterator[list[tuple]]) -> None:
        nonlocal number
        for pieces in sequences:
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), ids.tobytes(), total, number, offset))
                offset += len(ids)
            number += 1

    def out() -> pa.RecordBatch:
        doc, start, length, ids, total, sequence, offset = zip(*rows) if rows else [()] * 7
        rows.clear()
        longs = {"doc_id": doc, "start": start, "length": length, "doc_tokens": total, "sequence_id": sequence, "offset": offset}
        columns = {k: pa.array(v, pa.int64()) for k, v in longs.items()} | {"ids": pa.array(ids, pa.binary())}
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    for batch in batches:
        texts, docs = texts_of(batch), batch.column("doc_id").to_pylist()
        for a, b in slices(batch, [*map(len, texts)], BATCH_BYTES):
            flat, sizes = enc.encode(texts[a:b], end)
            flat, at = flat.astype("<u4"), 0
            for doc, size in zip(docs[a:b], sizes.tolist()):
                for start in range(0, size, window):
                    stop = min(size, start + window)
                    put(packer.add((doc, start, flat[at + start : at + stop].copy(), size)))
                at += size
            yield out()
    put(packer.close())
    yield out()


def pack(docs: DataFrame, vocabulary: str = WORD_BPE, end_id: int = END_ID, window: int = WINDOW, open_ids: int = OPEN_IDS) -> DataFrame:
    """A row a piece: doc_id, start in its document, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(partial(_pack, path=vocabulary_path(vocabulary), end=end_id, window=window, open_ids=open_ids), PIECES)


def pieces_digest(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(table(spark, sf_dir, "documents"))
