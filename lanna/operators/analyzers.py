"""Segmentation of columns, the native tokenizer for text without Thai, and the analyzer presets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.functions.scalar import contains_thai, keyboard_text, lower
from lanna.operators import filters
from lanna.operators.normalize import normalize
from lanna.operators.segment import MODES, SPACE, WORD, tokens
from lanna.session import ship
from lanna.sources.dictionary import Lexicon

#: Pieces of text without Thai, white space included, as the segmenter cuts them.
PIECE = f"{WORD}|{SPACE}"


def native_terms(text: Column) -> Column:
    """Terms of text without Thai, without Python: one greedy expression."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def cut_portions(batches: Iterator[pa.Array], cut: Callable[[str], list[tuple]]) -> Iterator[pa.Array]:
    """The tokens of batches of texts, an array for each portion of a batch."""
    made = lambda texts: filters.token_arrays([cut(t) if t else [] for t in texts])
    for batch in batches:
        yield from (filters.once(texts, made) for texts in filters.portions(batch.fill_null("")))


class Cutter:
    """A vectorized function from a text column to tokens; the lexicon is broadcast once.  Null text gives an empty array.

    A batch is cut in portions, so a worker's memory doesn't grow with its texts; texts that a portion repeats are cut once.  Python steps that follow in a chain run in the same pass.
    """

    def __init__(self, spark: SparkSession, mode: str = "none", lexicon: Lexicon | None = None, utf16: bool = False, steps: filters.Steps | None = None):
        ship(spark)
        if mode.lower() not in MODES:
            raise ValueError(f"unknown decompound mode {mode}")
        self.mode, self.utf16, self.steps = mode, utf16, steps or filters.Steps()
        self.shared = lexicon if lexicon is None or isinstance(lexicon, Broadcast) else spark.sparkContext.broadcast(lexicon)

    def then(self, steps: filters.Steps) -> Cutter:
        other = copy(self)
        other.steps = filters.Steps(*self.steps.steps, *steps.steps)
        return other

    def __call__(self, column: Column) -> Column:
        mode, utf16, shared, rows = self.mode, self.utf16, self.shared, self.steps.rows

        @F.arrow_udf(filters.TOKENS)
        def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            words = None if shared is None else shared.value
            yield from cut_portions(batches, lambda t: rows(tokens(t, mode, words, utf16)))

        return apply(column)


def segmenter(spark: SparkSession, mode: str = "none", lexicon: Lexicon | None = None, utf16: bool = False) -> Cutter:
    """A function from text to tokens."""
    return Cutter(spark, mode, lexicon, utf16)


def reloadable(spark: SparkSession, load: Callable[[], Lexicon], mode: str = "none") -> Callable[[Column], Column]:
    """A segmenter whose lexicon is loaded anew, and sent anew, each time it is applied to a column, so that a later batch job sees edits."""
    return lambda text: segmenter(spark, mode, load())(text)


def final_offsets(text: Column, utf16: bool = False) -> Column:
    """Where the token streams of a column end: the whole length, white space included."""
    return F.coalesce(F.length(text) + (F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", "")) if utf16 else 0), F.lit(0))


def all_terms(spark: SparkSession, text: Column, lexicon: Lexicon | None = None) -> Column:
    """Terms of any text: without Thai by the native expression, so that only texts with Thai letters reach Python."""
    thai = contains_thai(text)
    return F.when(thai, segmenter(spark, lexicon=lexicon)(F.when(thai, text))["term"]).otherwise(native_terms(text))


def native_token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row a token of text without Thai: key, position, term, start, end; a text's offsets are found in one pass over it, so nothing is shuffled."""
    cut = df.select(key, segmenter(df.sparkSession)(F.col(text)).alias("tokens"))
    return cut.select(key, F.posexplode("tokens").alias("position", "t")).select(key, F.col("position").cast("long").alias("position"), "t.term", F.col("t.start").cast("long").alias("start"), F.col("t.end").cast("long").alias("end"))


def normalized(spark: SparkSession) -> Callable[[Column], Column]:
    """Canonical spelling of a whole column."""
    ship(spark)

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(normalize, na_action="ignore")

    return apply


def keyword(spark: SparkSession) -> Callable[[Column], Column]:
    """The normalizer of keyword fields: canonical spelling in lower case."""
    spell = normalized(spark)
    return lambda text: lower(spell(text))


def chain(steps: list[Callable[[Column], Column]]) -> Callable[[Column], Column]:
    """Functions one after another; Python steps side by side, and those after a segmenter, become one."""
    merged: list = []
    for step in steps:
        last = merged[-1] if merged else None
        if isinstance(step, filters.Steps) and isinstance(last, Cutter):
            merged[-1] = last.then(step)
        elif isinstance(step, filters.Steps) and isinstance(last, filters.Steps):
            merged[-1] = filters.Steps(*last.steps, *step.steps)
        else:
            merged.append(step)
    return lambda column: reduce(lambda c, step: step(c), merged, column)


def analyzer(spark: SparkSession, mode: str = "none", normalization: bool = True, stop_words: list[str] | None = None, lexicon: Lexicon | None = None) -> Callable[[Column], Column]:
    """The standard preset: segmentation, canonical spelling, lower case, stop words."""
    steps = [filters.normalization()] if normalization else []
    steps.append(filters.lowercase)
    if stop_words:
        steps.append(lambda c: filters.stop(c, stop_words))
    return chain([segmenter(spark, mode, lexicon), *steps])


def person_analyzer(spark: SparkSession, mode: str = "mixed", tone: bool = True, soundex: bool = True, normalization: bool = True, lexicon: Lexicon | None = None) -> Callable[[Column], Column]:
    """The preset for names: compounds and parts, spellings without tones, phonetic codes."""
    steps = [filters.normalization()] if normalization else []
    steps.append(filters.lowercase)
    steps += [filters.tone] if tone else []
    steps += [filters.soundex] if soundex else []
    return chain([segmenter(spark, mode, lexicon), *steps])


#: The presets' names.
ANALYZERS = {"thai": analyzer, "thai_person": person_analyzer}
#: Filters by name; those that need settings only known at run time are made by calling the entry.
FILTERS = {
    "thai_keyboard": lambda **s: lambda c: filters.keyboard(c, **s), "thai_soundex": lambda **s: lambda c: filters.soundex(c, **s), "thai_tone": lambda **s: lambda c: filters.tone(c, **s),
    "thai_number": filters.number, "thai_acronym": lambda **s: lambda c: filters.acronym(c, **s), "thai_romanization": filters.romanization,
    "thai_collation": lambda **s: lambda c: filters.collation(c, **s), "normalization": lambda: filters.normalization(), "lowercase": lambda: filters.lowercase, "stop": lambda words: lambda c: filters.stop(c, words),
}
#: The order in which filters are best chained, after a character filter.
ORDER = ("thai_keyboard_text", "normalization", "lowercase", "thai_keyboard", "thai_soundex", "thai_tone", "thai_number", "thai_acronym", "thai_romanization", "thai_collation")


def custom(spark: SparkSession, names: list[str], mode: str = "none", lexicon: Lexicon | None = None, settings: dict[str, dict] | None = None) -> Callable[[Column], Column]:
    """A chain of named filters after segmentation; an unknown name is an error."""
    return chain([segmenter(spark, mode, lexicon), *(FILTERS[n](**(settings or {}).get(n, {})) for n in names)])


def recommended(spark: SparkSession, names: list[str], mode: str = "none", lexicon: Lexicon | None = None, settings: dict[str, dict] | None = None) -> Callable[[Column], Column]:
    """The named filters in the best order; `thai_keyboard_text` converts the text before it is cut."""
    unknown = set(names) - set(ORDER)
    if unknown:
        raise KeyError(*sorted(unknown))
    how = custom(spark, [n for n in ORDER[1:] if n in names], mode, lexicon, settings)
    way = (settings or {}).get(ORDER[0], {})
    return (lambda text: how(keyboard_text(text, **way))) if ORDER[0] in names else how


def analyzed(df: DataFrame, text: str, how: Callable[[Column], Column], into: str = "tokens") -> DataFrame:
    """`df` with a column of tokens."""
    return df.withColumn(into, how(F.col(text)))


def rows(df: DataFrame, key: str, tokens_column: str = "tokens") -> DataFrame:
    """A row a token, with its absolute position in the token graph."""
    tokens = F.col(tokens_column)
    positions = filters.running("sum")(F.transform(tokens, lambda t: t["pos_inc"]))
    placed = F.zip_with(tokens, positions, lambda t, p: F.struct((p - 1).alias("position"), t.alias("t")))
    found = df.select(key, F.explode_outer(placed).alias("x")).where(F.col("x").isNotNull())  # see retrieval.terms
    return found.select(key, "x.position", "x.t.*")


def register_udtf(spark: SparkSession, name: str = "thai_tokens") -> None:
    """`LATERAL thai_tokens(text, mode)` in SQL: a row a token."""
    ship(spark)

    @F.udtf(returnType="term string, start int, end int, pos_inc int, pos_len int, type string")
    class Tokens:
        def eval(self, text: str, mode: str):
            yield from tokens(text, mode or "none")

    spark.udtf.register(name, Tokens)
