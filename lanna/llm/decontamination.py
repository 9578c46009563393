"""Benchmark decontamination by template windows and slot consistency.

A text becomes a template: words in lower case without the signs around them,
numbers as <num>, units after numbers as <unit>, runs of capitalised words of a
sentence as <name>, also where they begin it; an item is read once more without names, so that
copies of it in lower case or in capitals are found.  Windows of WINDOW template tokens, at least LITERAL of them
words, are hashed and joined with the benchmark's; an item too short for that is
one window of its whole wording.  Matches of a document and an item are put on
diagonals (place in the document less place in the item).  On a diagonal the slots
must be consistent: equal numbers, units or names of the item have equal ones in the
document.  So a question with other numbers or names is caught, and a chance likeness
that mixes values is not.  A document is reported for an item if consistent
diagonals hold at least COVERAGE of the item's windows.

The benchmark's window hashes filter the documents' windows before the join, if they
are at most FILTER_MOST (sorted 64-bit integers, 8 MB); a larger benchmark is joined
by a shuffle without that filter, with the same result.

Defined results: null or empty texts and items match nothing; a null doc_id or item_id is
reported as null; rows with one doc_id, or with none, are judged each by its own text and
reported once for an item; repeated items of one item_id count as one; an empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.llm.common import bounded_batches, slices, table, take_turn, written
from lanna.llm.substrings import mixed, rolling

WINDOW = 8
LITERAL = 4
COVERAGE = 0.5
FILTER_MOST = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 200_000
WORD, NUMBER, UNIT, NAME, SIGN = range(5)
_MARKS = mixed(np.arange(5, dtype=np.uint64) + np.uint64(7))
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[$€£+-]?[0-9][0-9.,:/]*(?:%|[A-Za-zµ°]{1,3})?")
UNITS = frozenset(
    """mm cm m km in ft yd mi mg g kg lb lbs oz t ml l cl dl gal s sec min h hr hrs ms ns hz khz mhz ghz w kw kwh mw v mv a ma j kj n pa kpa bar k c f percent dollar dollars
    euro euros pound pounds cent cents meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms ton tons tonne tonnes
    liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees kilo kilos heures jours ans mètres
    stunde stunden tage jahre meter euro horas días años metros""".split()
)


_WORD_ROW = np.dtype([("h", "u8"), ("kind", "i1"), ("capital", "?"), ("ends", "?")])


class _Words(dict):
    """Numbers words; keeps of each the hash of its wording, its kind, whether it begins with a capital, whether it ends a sentence."""

    def __init__(self):
        self.rows: list[tuple[int, int, bool, bool]] = []  # of words met since the last look
        self.known = np.zeros(0, _WORD_ROW)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        if word.isalpha():  # most words: no edges, no digits, no end of a sentence
            low = word.lower()
            self.rows.append((xxhash.xxh3_64_intdigest(low), UNIT if low in UNITS else WORD, word[0].isupper() and not word[1:].isupper(), False))
            return n
        bare = _EDGE.sub("", word)
        low = bare.lower()
        kind = SIGN if not bare else NUMBER if _NUMBER.fullmatch(word.strip(".,;:!?()[]\"'")) or bare.isdigit() else UNIT if low in UNITS else WORD
        self.rows.append((xxhash.xxh3_64_intdigest(low), kind, bare[:1].isupper() and not bare[1:].isupper(), word.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":", "|")))
        return n

    def table(self) -> np.ndarray:
        if self.rows:
            self.known = np.concatenate([self.known, np.array(self.rows, _WORD_ROW)])
            self.rows = []
        return self.known


class Templates:
    """The templates of some texts, one after another: hash and kind of each token, and the words that each stands for."""

    _words = _Words()

    @classmethod
    def forget(cls) -> None:
        cls._words = _Words()

    def __init__(self, texts: list[str | None], names: bool = True):
        take_turn("decontamination", Templates.forget)
        if len(self._words) > _WORDS_KEPT:
            Templates._words = _Words()
        find, self.raw, parts = self._words.__getitem__, [], []
        for t in texts:
            own = (t or "").split()
            self.raw += own
            parts.append(np.fromiter(map(find, own), np.int64, len(own)))
        counts = [*map(len, parts)]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        known = self._words.table()[at]
        doc = np.repeat(np.arange(len(parts)), counts)
        #: Whether a token begins a sentence.
        self.begins = first = np.r_[True, (doc[1:] != doc[:-1]) | known["ends"][:-1]] if len(doc) else np.zeros(0, bool)
        kind = known["kind"].astype(np.int64)
        before = np.r_[SIGN, kind[:-1]] if len(kind) else kind
        kind[(kind == UNIT) & ((before != NUMBER) | first)] = WORD
        if names:
            kind[(kind == WORD) & known["capital"]] = NAME
        keep = kind != SIGN
        keep[1:] &= ~((kind[1:] == NAME) & (kind[:-1] == NAME) & ~first[1:])
        self.source = np.flatnonzero(keep)
        self.kind, self.doc = kind[keep], doc[keep]
        self.hash = np.where(self.kind == WORD, known["h"][keep], _MARKS[self.kind])
        self.wording = known["h"][keep]
        self.first = np.searchsorted(self.doc, np.arange(len(parts)))
        self.counts = np.bincount(self.doc, minlength=len(parts))
        self._all_kinds = kind

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all windows with enough words."""
        n = len(self.hash) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        words = np.cumsum(np.r_[0, self.kind == WORD])
        at = np.flatnonzero((self.doc[:n] == self.doc[WINDOW - 1 :]) & (words[WINDOW:] - words[:-WINDOW] >= LITERAL))
        return at, mixed(rolling(self.hash, WINDOW, _BASE))[at]

    def short(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the wording of all runs of `length` tokens, for items that have no window."""
        n = len(self.hash) - length + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        return at, mixed(rolling(self.wording, length, _BASE) + np.uint64(length))[at]

    def slots(self, at: int, length: int) -> list[str]:
        """What the placeholders of a window stand for."""
        out = []
        for k in range(at, at + length):
            if self.kind[k] != WORD:
                stop = start = int(self.source[k])
                while self.kind[k] == NAME and stop + 1 < len(self.raw) and self._all_kinds[stop + 1] == NAME and not self.begins[stop + 1]:
                    stop += 1
                out.append(" ".join(_EDGE.sub("", w).lower() for w in self.raw[start : stop + 1]))
        return out


ITEMS = "item_id long, reading int, hash long, item_at int, item_slots array<string>, windows int, length int"
HITS = "doc_id long, text_md5 binary, hash long, at int, slots array<string>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            t = Templates([text])
            at, h = t.windows()
            if not len(at) and len(t.hash):  # too short for a window: the whole wording is one
                n = len(t.hash)
                at, h = t.short(n)
                rows += [(item, 0, x, p, t.slots(p, n), len(at), n) for p, x in zip(at.tolist(), h.view(np.int64).tolist())]
                continue
            for reading, own in enumerate((t, Templates([text], False)) if (t.kind == NAME).any() else (t,)):
                at, h = own.windows()
                rows += [(item, reading, x, p, own.slots(p, WINDOW), len(at), 0) for p, x in zip(at.tolist(), h.view(np.int64).tolist())]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 7, kinds)], [x.split()[0] for x in ITEMS.split(", ")])


def _hits(batches: Iterator[pa.RecordBatch], wanted, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """The windows of the documents, or with `wanted`, a sorted array of hashes, those in it."""
    sought = None if wanted is None else wanted.value
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in slices(batch, [len(t or "") for t in texts]):
            t, rows, prints = Templates(texts[a:b]), [], {}
            for length in (0, *lengths):
                at, h = t.short(length) if length else t.windows()
                if sought is not None and len(at):
                    good = sought[np.minimum(np.searchsorted(sought, h), len(sought) - 1)] == h
                    at, h = at[good], h[good]
                for p, x in zip(at.tolist(), h.view(np.int64).tolist()):
                    row = a + int(t.doc[p])
                    if row not in prints:
                        prints[row] = hashlib.md5(texts[row].encode()).digest()
                    rows.append((ids[row], prints[row], x, p - int(t.first[t.doc[p]]), t.slots(p, length or WINDOW)))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["doc_id", "text_md5", "hash", "at", "slots"])


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, filter_most: int = FILTER_MOST) -> DataFrame:
    """doc_id, text_md5, item_id, n_windows found, coverage of the item, exact (all slots have the item's values); a row for each text of an id and each item that is reported."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(plain.mapInArrow(_items, ITEMS))
    lengths = sorted(r["length"] for r in items.select("length").where("length > 0").distinct().collect())  # the lengths of short items, or of those that are almost all slots
    wanted = None
    hashes = items.select("hash").distinct()
    if hashes.limit(filter_most + 1).count() <= filter_most:  # the size is checked before anything is sent
        sought = np.sort(hashes.toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
        if not len(sought):
            sought = np.zeros(1, np.uint64)
        wanted = spark.sparkContext.broadcast(sought)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = texts.mapInArrow(partial(_hits, wanted=wanted, lengths=lengths), HITS)

    pairs = hits.join(items, "hash").where(F.size("slots") == F.size("item_slots"))
    pairs = pairs.withColumn("slot", F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours"))).select("doc_id", "text_md5", "item_id", "reading", "windows", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), "slot")
    lines = pairs.groupBy("doc_id", "text_md5", "item_id", "reading", "windows", "diagonal").agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("slot"))).alias("slots"))  # as long as the item at most
    theirs = F.size(F.array_distinct(F.transform("slots", lambda s: s["theirs"])))
    lines = lines.where(theirs == F.size("slots")).withColumn("exact", F.forall("slots", lambda s: s["theirs"] == s["ours"]))
    found = lines.groupBy("doc_id", "text_md5", "item_id", "reading", "windows").agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"), F.max("exact").alias("exact"))
    found = found.withColumn("coverage", F.round(F.col("n_windows") / F.col("windows"), 6)).where(F.col("n_windows") / F.col("windows") >= coverage)
    best = found.groupBy("doc_id", "text_md5", "item_id").agg(F.max(F.struct("coverage", "n_windows")).alias("x"), F.max("exact").alias("exact"))  # of the readings
    return best.select("doc_id", "text_md5", "item_id", "x.n_windows", "x.coverage", "exact")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, filter_most: int = FILTER_MOST) -> DataFrame:
    """doc_id, item_id, n_windows found, coverage of the item, exact (all slots have the item's values); a row for each pair that is reported, of several texts of an id the one that covers most."""
    found = contaminated_texts(docs, benchmark, coverage, filter_most)
    best = F.max(F.struct("coverage", "n_windows", "exact")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.n_windows", "x.coverage", "x.exact")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, whose text holds no benchmark item."""
    bad = written(contaminated_texts(docs, benchmark).select("text_md5").distinct())
    return docs.join(bad, F.unhex(F.md5(F.col("text").cast("binary"))) == bad["text_md5"], "left_anti")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
