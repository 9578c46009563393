"""Language identification by words first, backing off to character n-grams.

A known word scores by its log frequency in each language; an unknown one by the
longest character n-grams of it (5 down to 1, with marks for its ends) that are
known, and by nothing if not even a letter is.  A text's scores are the sums over
all its words plus the log share of the language's texts.

Counts cover all labelled texts of the training fold, words and n-grams alike: the
n-grams are counted in Spark over all words.  The model that is broadcast is bounded:
each language has the same part of MAX_WORDS and MAX_GRAMS, and gives its most frequent
words and n-grams (ties in order of the text), so that none loses them to another one.
Frequencies are relative to all that was counted in a language.

Defined results: null text, or one without a letter, is `und` with score 0, and so
is everything if no row can be learned from; null doc_ids stay null and are not in
the training fold's complement; repeated rows count repeatedly; an empty table gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.llm.common import bounded_batches, table, take_turn, texts_of, written

MAX_WORDS = 60_000
MAX_GRAMS = 200_000
MAX_GRAM = 5
UNKNOWN = "und"
FLUSH = 100_000
CACHE = 100_000



def _numerals() -> str:
    """Characters that count as parts of words but are neither letters nor decimal digits, as ranges: superscripts, fractions, Roman and circled numbers."""
    own = [c for c in range(0x110000) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    ends = [c for c in own if c + 1 not in own_set] if (own_set := set(own)) else []
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip((c for c in own if c - 1 not in own_set), ends))


#: Runs of letters.
_WORD = re.compile(rf"[^\W\d_{_numerals()}]+")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with marked ends; single letters without the marks."""
    if n == 1:
        return list(word)
    marked = f"\x02{word}\x03"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(w, lang, n) for lang, own in seen.items() for w, n in own.items()]
        seen.clear()
        word, lang, n = zip(*rows) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(lang, pa.string()), pa.array(n, pa.int64())], ["word", "lang", "n"])

    for batch in batches:
        for text, lang in zip(texts_of(batch), batch.column("lang").to_pylist()):
            seen[lang].update(_WORD.findall(text.lower()))
            if len(seen[lang]) > FLUSH:
                yield out()
    yield out()


def gram_table(words: list[str], types: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
    """n-grams of words and the sums of the words' rows for each."""
    index, source, target = {}, [], []
    for k, w in enumerate(words):
        for g in grams(w, n):
            source.append(k)
            target.append(index.setdefault(g, len(index)))
    own = np.zeros((len(index), types.shape[1]))
    np.add.at(own, np.array(target, int), types[np.array(source, int)])
    return [*index], own


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, langs = batch.column("word").to_pylist(), batch.num_columns - 1
        types = np.log1p(np.array([batch.column(f"n{k}").to_numpy() for k in range(langs)], float).T.reshape(-1, langs))  # n-grams stand for unseen words, so types count more than tokens
        for n in range(1, MAX_GRAM + 1):
            found, own = gram_table(words, types, n)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(found), pa.int32()), pa.array(found, pa.string()), *map(pa.array, own.T.copy())], ["size", "gram", *(f"n{k}" for k in range(langs))])


class Model:
    """Word and n-gram tables with a row of log frequencies each; one column a language.

    `totals` are the counts of all words, also those without a row; `tables` has n-grams, their rows and the totals for each size from 1.
    Without them, they are taken from `words`.
    """

    def __init__(self, langs: list[str], texts: np.ndarray, words: dict[str, np.ndarray], totals: np.ndarray | None = None, tables: list[tuple[list[str], np.ndarray, np.ndarray]] | None = None):
        self.langs = langs
        self.prior = np.log((texts + 1) / (texts + 1).sum()) if len(langs) else np.zeros(0)
        self.grams: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
        counts = np.array(list(words.values()), float).reshape(len(words), len(langs))
        totals = counts.sum(axis=0) if totals is None else totals
        rows = [np.log((counts + 0.05) / (totals + 0.05 * len(words) + 1))] if len(words) else []
        self.words = {w: k for k, w in enumerate(words)}
        at = len(words)
        if tables is None:
            tables = [(found, own, own.sum(axis=0)) for found, own in (gram_table([*words], np.log1p(counts), n) for n in range(1, MAX_GRAM + 1))]
        for n, (found, own, whole) in enumerate(tables, 1):
            if len(found):
                rows.append(np.log((own + 0.05) / (whole + 0.05 * len(found))))
                self.grams[n] = {g: at + k for k, g in enumerate(found)}
                at += len(found)
        self.logs = (np.vstack(rows) if rows else np.zeros((0, len(langs)))).astype(np.float32)

    def known(self, word: str) -> list[int]:
        """Rows of the longest known n-grams of a word."""
        for n in range(min(MAX_GRAM, len(word) + 2), 0, -1):
            found = [*map(self.grams[n].get, grams(word, n))]
            if any(x is not None for x in found):
                return [x for x in found if x is not None]
        return []


class _Rows(dict):
    """Row numbers of words; unknown ones get a further row when they are first met: the mean of their n-grams' rows."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.logs, self.new = model, model.logs, []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self.logs) + len(self.new)
        self.new.append(self.model.known(word))
        return row

    def all_logs(self) -> np.ndarray:
        if self.new:
            counts = np.fromiter(map(len, self.new), np.int64, len(self.new))
            rows, some = np.zeros((len(counts), self.logs.shape[1]), np.float32), np.flatnonzero(counts)
            if len(some):
                flat = self.model.logs[np.fromiter(chain.from_iterable(self.new), np.int64)]
                rows[some] = np.add.reduceat(flat, (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
            self.logs, self.new = np.vstack([self.logs, rows]), []
        return self.logs


class _Predictor:
    """Predicts lists of texts; words' rows are kept from one list to the next."""

    def __init__(self, model: Model):
        self.model, self.rows = model, None
        self.langs = np.array(model.langs + [UNKNOWN])

    def _forget(self) -> None:
        self.rows = None

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        model = self.model
        take_turn("language", self._forget)
        if self.rows is None or len(self.rows) > len(model.words) + CACHE:
            self.rows = _Rows(model)
        score, best, found = np.zeros(len(texts)), np.full(len(texts), len(model.langs)), []
        for text in texts:
            words = _WORD.findall(text.lower())
            found.append(np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)))
        logs = self.rows.all_logs()
        for k, at in enumerate(found):
            if len(at) and len(model.langs):
                total = logs[at].sum(axis=0, dtype=np.float64) + model.prior
                best[k] = int(np.argmax(total))
                score[k] = 1 / np.exp(total - total[best[k]]).sum()
        return self.langs[best].tolist(), score


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    predict = _Predictor(model.value)
    for batch in batches:
        langs, score = predict(texts_of(batch))
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])


def _accept(batches: Iterator[pa.RecordBatch], model, column: int, least: float) -> Iterator[pa.RecordBatch]:
    predict = _Predictor(model.value)
    for batch in batches:
        langs, score = predict([x or "" for x in batch.column(column).to_pylist()])
        yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, score.tolist())], pa.bool_()))


def _most(counts: DataFrame, langs: int, most: int, *names: str):
    """Rows of `counts` that are among the `most` / `langs` most frequent of a language, as a pandas table in the order of `names`."""
    tops = [counts.where(F.col(f"n{k}") > 0).orderBy(F.desc(f"n{k}"), *names).limit(max(1, most // langs)) for k in range(langs)]
    return reduce(DataFrame.unionAll, tops).toPandas().drop_duplicates([*names]).sort_values([*names])


def fit(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learns from text and lang of the labelled documents that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    fold = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    fold = fold.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shares = {r["lang"]: r["n"] for r in fold.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(shares)
    if not langs:
        return Model([], np.zeros(0), {})
    columns = [f"n{k}" for k in range(len(langs))]
    counts = written(fold.mapInArrow(_count, "word string, lang string, n long").groupBy("word").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(c) for c, x in zip(columns, langs)]))
    of_words = written(counts.mapInArrow(_gram_counts, "size int, gram string, " + ", ".join(f"{c} double" for c in columns)).groupBy("size", "gram").agg(*[F.round(F.sum(c), 6).alias(c) for c in columns]))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in columns]
    totals = np.array(counts.agg(*sums).first(), float)
    wholes = {r["size"]: np.array(r[1:], float) for r in of_words.groupBy("size").agg(*sums).collect()}
    top = _most(counts, len(langs), max_words, "word")
    words = dict(zip(top["word"], top[columns].to_numpy(float)))
    top = _most(of_words, len(langs), max_grams, "size", "gram")
    tables = []
    for n in range(1, MAX_GRAM + 1):
        own = top[top["size"] == n]
        tables.append((own["gram"].tolist(), own[columns].to_numpy(float), wholes.get(n, np.zeros(len(langs)))))
    return Model(langs, np.array([shares[x] for x in langs], float), words, totals, tables)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by max_words and max_grams
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return plain.mapInArrow(partial(_predict, model=shared), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, whose text has a language that is at least so likely."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_accept, model=shared, column=docs.columns.index("text"), least=least), docs.schema)


def op2_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
