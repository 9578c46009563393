"""Substring dedup: Rabin-Karp hashes of all fixed-length word windows, counted in Spark.

Words are runs of bytes other than ASCII white space.  A window of WINDOW words is
removed if its word sequence starts earlier too: in a document with a smaller doc_id,
or further left in the same one.  Overlapping windows merge into maximal intervals.

Two windows are equal only if their smallest GRAM-word hash, at the same place in
both, is.  So first only these anchors (one in seven words) are shuffled and counted;
what is shuffled next are the 128-bit hashes of windows whose anchor repeats.  Equal
windows that meet in one batch of documents settle it there, so a passage that a
third of all documents share reaches the shuffle once a batch.  A whole text that an
earlier document has is found by its md5 and not cut into windows again.

Two words differ if their xxh3 hashes do, two windows if two independent 64-bit
polynomials over them do, two texts if their md5 do, two texts of one doc_id if
their xxhash64 do.

Defined results: null or empty text has no words; a null doc_id counts as the largest
one; rows with the same doc_id are each judged against smaller ids and themselves,
not against one another, so repeated rows give repeated results; an empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanna.llm.common import bounded_batches, slices, table, take_turn

WINDOW = 20
GRAM = 8
LAST_ID = (1 << 63) - 1
_BASES = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)))
_DOC = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_WORDS_KEPT = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of n, from those of runs of powers of two."""
    out, length, run, have, power = None, 1, h, 0, base
    while True:
        if n & length:
            m = len(h) - have - length + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            out = run[have : have + m] if out is None else out[:m] * power + run[have : have + m]
            have += length
        if have == n:
            return out[: len(h) - n + 1]
        run = run[:-length] * power + run[length:] if len(run) > length else np.zeros(0, np.uint64)
        length, power = 2 * length, np.uint64(int(power) ** 2 & _MASK)


class Words:
    """Word hashes of some texts, one after another."""

    _hashes = _Hashes()

    def __init__(self, texts: list[str | None]):
        take_turn("substrings", self._hashes.clear)
        if len(self._hashes) > _WORDS_KEPT:
            self._hashes.clear()
        find, parts = self._hashes.__getitem__, []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            parts.append(np.fromiter(map(find, words), np.uint64, len(words)))
        self.counts = np.fromiter(map(len, parts), np.int64, len(parts))
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(parts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all windows, the smallest GRAM-word hash of each, and the first place of that."""
        if len(self.hashes) < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        least, have, n = mixed(rolling(self.hashes, GRAM, _BASES[0])), 1, WINDOW - GRAM + 1
        place = np.arange(len(least))
        while have < n:
            step = min(have, n - have)
            left = least[:-step] <= least[step:]
            least, place, have = np.where(left, least[:-step], least[step:]), np.where(left, place[:-step], place[step:]), have + step
        at = np.flatnonzero(self.doc[: len(least)] == self.doc[WINDOW - 1 :])
        return at, least[at], place[at]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two 64-bit hashes of the windows at `at`."""
        return rolling(self.hashes, WINDOW, _BASES[0])[at], rolling(mixed(self.hashes), WINDOW, _BASES[1])[at]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, doc_id, text_key, n: 2 if the document has the anchor at several places."""
    for batch in batches:
        ids, keys, texts = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy(), batch.column("text").to_pylist()
        for a, b in slices(batch, [len(t or "") for t in texts]):
            own = dict(sorted(zip(texts[a:b], zip(ids[a:b].tolist(), keys[a:b].tolist())), key=lambda x: -x[1][0]))  # of equal texts the smallest id
            docs, own_keys = np.array([*own.values()], np.int64).reshape(-1, 2).T
            words = Words([*own])
            at, anchor, place = words.anchors()
            if not len(at):
                continue
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            doc = words.doc[at[starts]]
            _, index, n = np.unique(anchor[starts] + doc.astype(np.uint64) * _DOC, return_index=True, return_counts=True)
            at = starts[index]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(docs[doc[index]]), pa.array(own_keys[doc[index]]), pa.array(np.minimum(2, n).astype(np.int32))], ["anchor", "doc_id", "text_key", "n"])


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First indices and lengths of runs of consecutive places in a document; sorted input."""
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(at)])


OPEN = "h1 long, h2 long, doc_id long, text_key long, at int, n int, sure boolean"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with a repeated anchor: those that repeat within the batch as runs (sure), of the others the first of each."""
    for batch in batches:
        ids, keys, texts, anchors = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy(), batch.column("text").to_pylist(), batch.column("anchors")
        for a, b in slices(batch, [len(t or "") for t in texts]):
            words = Words(texts[a:b])
            at, anchor, _ = words.anchors()
            lists = [x.values.to_numpy().view(np.uint64) for x in anchors[a:b]]
            which = np.concatenate([x + np.uint64(k * int(_DOC) & _MASK) for k, x in enumerate(lists)])
            at = at[np.isin(anchor + words.doc[at].astype(np.uint64) * _DOC, which)]
            if not len(at):
                continue
            h1, h2 = words.windows(at)
            doc = words.doc[at]
            own_ids = ids[a:b]
            order = np.lexsort((at, own_ids[doc], h2, h1))
            h1s, h2s, rows, ids_s = h1[order], h2[order], doc[order], own_ids[doc[order]]
            new = np.r_[True, (h1s[1:] != h1s[:-1]) | (h2s[1:] != h2s[:-1])]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)[group]
            # A row is settled if a smaller id or the same row further left has the window.
            same_row = np.r_[False, (rows[1:] == rows[:-1]) & ~new[1:]]
            if len(np.unique(own_ids)) < len(own_ids):  # rows with one doc_id may lie between
                seen = np.lexsort((at[order], rows, group))
                same_row[seen[1:]] = (rows[seen[1:]] == rows[seen[:-1]]) & (group[seen[1:]] == group[seen[:-1]])
            sure = (ids_s > ids_s[first]) | same_row
            key = keys[a:b]
            place = at - words.first[doc]
            back = np.empty(len(at), bool)
            back[order] = sure
            s, n = _runs(doc[back], place[back])
            d, p = doc[back][s], place[back][s]
            o = np.flatnonzero(~back)
            columns = [
                np.r_[h1[o].view(np.int64), (own_ids[d].astype(np.uint64) * _DOC + p.astype(np.uint64)).view(np.int64)], np.r_[h2[o].view(np.int64), d.astype(np.int64)],
                np.r_[own_ids[doc[o]], own_ids[d]], np.r_[key[doc[o]], key[d]], np.r_[place[o], p].astype(np.int32), np.r_[np.ones(len(o)), n].astype(np.int32), np.r_[np.zeros(len(o), bool), np.ones(len(s), bool)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in OPEN.split(", ")])


KEPT = "row_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in KEPT.split(", ")[:3]] + ["removed", "kept"]
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs")):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            spans: list[tuple[int, int]] = []
            if runs.is_valid:
                at, n = (runs.values.field(k).to_numpy().tolist() for k in range(2))
                for p, m in sorted(zip(at, n)):
                    if p < 0 and len(words) < WINDOW:
                        continue
                    p, q = (0, len(words)) if p < 0 else (p, p + m - 1 + WINDOW)
                    if spans and p <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(q, spans[-1][1]))
                    else:
                        spans.append((p, q))
            kept = words
            for p, q in reversed(spans):
                kept = kept[:p] + kept[q:]
            for column, value in zip(rows, (len(words), len(words) - len(kept), [{"start": p, "end": q} for p, q in spans], b" ".join(kept))):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), *map(pa.array, rows[:3], kinds), pa.array(rows[3], pa.binary()).cast(pa.string())], names)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, removed (maximal word intervals) and kept (the other words, joined by spaces)."""
    bounded_batches(docs.sparkSession)
    row_id = F.col("doc_id").cast("long")
    docs = docs.select(F.coalesce(row_id, F.lit(LAST_ID)).alias("doc_id"), row_id.alias("row_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))

    # Whole texts that an earlier document has: only ids, keys and md5 are shuffled.
    prints = docs.select("doc_id", "text_key", F.unhex(F.md5("text")).alias("print"), (F.length("text") >= 2 * WINDOW - 1).alias("long")).where("long").drop("long")
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = prints.join(firsts, "print").where("doc_id > first_id").select("doc_id", "text_key").distinct()

    # What belongs to a document is keyed by its id and its text, so rows with one id, or none, are apart.
    anchors = docs.select("doc_id", "text_key", "text").mapInArrow(_anchors, "anchor long, doc_id long, text_key long, n int")
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    lists = anchors.select("anchor", "doc_id", "text_key").join(repeated, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors"))  # as long as the document at most
    lists = lists.join(copies, ["doc_id", "text_key"], "left_anti")

    # With row_id, though unused here, the texts' exchange is the same as the last join's, and Spark reuses it.
    windows = docs.join(lists, ["doc_id", "text_key"]).select("doc_id", "text_key", "row_id", "text", "anchors").mapInArrow(_windows, OPEN)
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2"))  # a row for each batch that has the window
    removed = windows.withColumn("least", least).where("sure or doc_id > least").select("doc_id", "text_key", "at", "n")
    whole = copies.select("doc_id", "text_key", F.lit(-1).alias("at"), F.lit(0).alias("n"))
    runs = removed.unionByName(whole).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    return docs.join(runs, ["doc_id", "text_key"], "left").select("row_id", "text", "runs").mapInArrow(_cut, KEPT).withColumnRenamed("row_id", "doc_id")


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
