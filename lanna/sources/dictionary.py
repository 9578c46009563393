"""Lexicons, abbreviation and romanization tables: bundled, from files, or from inline rules."""

from __future__ import annotations

import math
import re
from functools import lru_cache
from importlib import resources

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.operators.normalize import match_form

ATOMIC = frozenset({"ตาราง", "สำหรับ"})


class Lexicon:
    """Words with weights as a prefix tree; the costs of the segmenter depend on the sum of all weights."""

    def __init__(self, words: dict[str, float] | None = None):
        self.words: dict[str, float] = {}
        self.tree: dict = {}
        self.total = 0.0
        self.longest = 0
        self._bridges: re.Pattern | str | None = None
        for word, weight in (words or {}).items():
            self.add(word, weight)

    def add(self, word: str, weight: float = 1.0, lower: bool = False) -> None:
        """Adds a word; of a repeated one the greater weight stays, but with `lower` the later one, while the sum keeps the greater."""
        if not word:
            return
        weight = weight if weight > 0 and math.isfinite(weight) else 1.0
        old = self.words.get(word)
        if old is not None and weight <= old and not lower:
            return
        self.total += max(0.0, weight - (old or 0.0))
        self.words[word] = weight
        self.longest, self._bridges = max(self.longest, len(word)), None
        node = self.tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = weight

    def prefixes(self, text: str, start: int) -> list[tuple[int, float]]:
        """(end, weight) of all words that begin at a place, shortest first."""
        found, node = [], self.tree
        for at in range(start, len(text)):
            node = node.get(text[at])
            if node is None:
                break
            if "" in node:
                found.append((at + 1, node[""]))
        return found

    def bridges(self) -> re.Pattern | None:
        """Finds the words that begin with a Thai letter and hold signs other than Thai ones and full stops, longest first."""
        if self._bridges is None:
            words = [w for w in self.words if "฀" <= w[0] <= "๿" and re.search("[^฀-๿.]", w)]
            self._bridges = re.compile("|".join(map(re.escape, sorted(words, key=len, reverse=True)))) if words else ""
        return self._bridges or None

    def __contains__(self, word: str) -> bool:
        return word in self.words

    def __len__(self) -> int:
        return len(self.words)

    def copy(self) -> Lexicon:
        return Lexicon(self.words)

    @property
    def heaviest(self) -> float:
        return max(self.words.values(), default=0.0)

    def __reduce__(self):
        return Lexicon, (self.words,)


def parse_words(lines: list[str], normal: bool = True) -> dict[str, float]:
    """`word` or `word<TAB>weight`; # comments; a bad weight or one not above 0 is 1; words take their matching form if `normal`."""
    found: dict[str, float] = {}
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        word, _, weight = line.partition("\t")
        try:
            value = float(weight) if weight.strip() else 1.0
        except ValueError:
            value = 1.0
        word = match_form(word.strip()) if normal else word.strip()
        found[word] = max(found.get(word, 0.0), value if value > 0 and math.isfinite(value) else 1.0)
    return found


def _resource(name: str) -> list[str]:
    text = resources.files("lanna.resources").joinpath(name).read_text("utf-8")
    return [x for x in text.splitlines() if x.strip() and not x.startswith("#")]


def ranks() -> list[tuple[str, str]]:
    """Short forms of the officers' ranks of army and police: grade, force and level."""
    return [
        (grade + force + level, grade_name + force_name + level_name)
        for force, force_name in (("", ""), ("ต.", "ตำรวจ"))
        for grade, grade_name in (("พล.", "พล"), ("พ.", "พัน"), ("ร.", "ร้อย"))
        for level, level_name in (("อ.", "เอก"), ("ท.", "โท"), ("ต.", "ตรี"))
    ]


def parse_short_forms(lines: list[str]) -> list[tuple[str, str]]:
    """(short form, full form) of `short<TAB>full` or `short=>full`; # comments; other lines are left out."""
    pairs = (x.partition("=>" if "=>" in x else "\t") for x in map(str.strip, lines) if not x.startswith("#"))
    return [(short.strip(), full.strip()) for short, sep, full in pairs if sep and short.strip() and full.strip()]


def parse_spellings(lines: list[str]) -> dict[str, tuple[str, ...]]:
    """Spellings of each word of `word<TAB>spelling[,spelling]` or `word=>...`; a later line replaces an earlier one."""
    return {word: spellings(latin) for word, latin in parse_short_forms(lines) if spellings(latin)}


@lru_cache(1)
def abbreviation_rows() -> tuple[tuple[str, str], ...]:
    """(short form, full form) of the bundled table."""
    return (*parse_short_forms(_resource("short_forms.txt")), *ranks())


@lru_cache(1)
def romanization_rows() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(word, spellings) of the bundled table."""
    return tuple(parse_spellings(_resource("latin_spellings.txt")).items())


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a table that every worker holds, so it fits the driver; a missing file is an error."""
    return [r["value"] for r in spark.read.text(path).collect()]


def load_short_forms(spark: SparkSession, path: str | None = None, rules: list[str] | None = None) -> list[tuple[str, str]]:
    """The bundled short forms, or those of a file in their place, and inline rules after them; of equal short forms the last counts."""
    return [*(abbreviation_rows() if path is None else parse_short_forms(_lines(spark, path))), *parse_short_forms(rules or [])]


def load_spellings(spark: SparkSession, path: str | None = None, rules: list[str] | None = None) -> dict[str, tuple[str, ...]]:
    """The bundled spellings, or those of a file in their place, and inline rules, which replace the spellings of their words."""
    return {**(dict(romanization_rows()) if path is None else parse_spellings(_lines(spark, path))), **parse_spellings(rules or [])}


def spellings(text: str) -> tuple[str, ...]:
    """Comma-joined spellings: trimmed, in lower case, each once."""
    return tuple(dict.fromkeys(x for x in (y.strip().lower() for y in text.split(",")) if x))


@lru_cache(1)
def default_lexicon() -> Lexicon:
    """The seed lexicon: entries of both tables, expansions, function words, numerals and everyday words, weight 1 each."""
    from lanna.functions.scalar import NUMBER_WORDS
    from lanna.operators.segment import BOUNDARY_WORDS, FUNCTION_PARTS

    words = [w for line in _resource("seed_words.txt") for w in line.split()]
    words += [w for w, _ in romanization_rows()] + [x for pair in abbreviation_rows() for x in pair]
    words += [*NUMBER_WORDS, *BOUNDARY_WORDS, *FUNCTION_PARTS]
    return Lexicon({match_form(w): 1.0 for w in words})


def load_lexicon(spark: SparkSession, paths: list[str] | None = None, rules: list[str] | None = None, base: Lexicon | None = None, graph: str | None = None, weights: str | None = None) -> Lexicon:
    """A copy of the base lexicon with the words of files and inline rules; files are read by Spark, a missing one is an error.

    With `graph`, a binary word graph, its words are the base, of weight 1 but for those that the file `weights` lists (`word<TAB>weight`,
    as they are written there).  A word of files or rules then takes the weight given there, a smaller one as well; the sum of weights
    follows only words that are new or grow.
    """
    if graph is not None:
        known = dict.fromkeys(read_dawg(spark, graph), 1.0)
        known |= {w: x for w, x in parse_words(_lines(spark, weights), False).items()} if weights else {}
        lexicon = Lexicon(known)
    else:
        lexicon = (default_lexicon() if base is None else base).copy()
    for lines in [*(_lines(spark, path) for path in paths or []), rules or []]:
        for word, weight in parse_words(lines).items():
            lexicon.add(word, weight, graph is not None)
    return lexicon


def lexicon_frame(spark: SparkSession, lexicon: Lexicon | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((default_lexicon() if lexicon is None else lexicon).words.items()), "word string, weight double")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word file of any size as (word, weight): the same words as `parse_words`, in matching form, of equal ones the greatest weight."""
    from lanna.session import ship

    ship(spark)

    @F.pandas_udf("string")
    def form(words: pd.Series) -> pd.Series:
        return words.map(match_form, na_action="ignore")

    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.split(line, "\t", 2).alias("x"))
    weight = F.trim(F.get("x", F.lit(1))).try_cast("double")
    good = F.when((weight > 0) & (weight < float("inf")), weight).otherwise(1.0)
    return rows.select(form(F.trim(F.get("x", F.lit(0)))).alias("word"), good.alias("weight")).groupBy("word").agg(F.max("weight").alias("weight"))


def abbreviation_frame(spark: SparkSession, rules: list[str] | None = None, path: str | None = None) -> DataFrame:
    """short, full, rank: the order of the table, in which of equal short forms the last counts and of equal full forms the first."""
    rows = [(short, full, k) for k, (short, full) in enumerate(load_short_forms(spark, path, rules))]
    return spark.createDataFrame(rows, "short string, full string, rank int")


def romanization_frame(spark: SparkSession, rules: list[str] | None = None, path: str | None = None) -> DataFrame:
    """word, spellings."""
    return spark.createDataFrame([(w, [*s]) for w, s in load_spellings(spark, path, rules).items()], "word string, spellings array<string>")


def base_variant(dictionary: DataFrame, base: DataFrame) -> DataFrame:
    """The dictionary's words that a base word list has too."""
    return dictionary.join(base.select("word").distinct(), "word", "left_semi")


class Dawg:
    """The binary word graph `TBD1`: little-endian; a state is a byte (bit 7 final, 7 bits of edges) and per edge two 16-bit numbers, character and target."""

    def __init__(self, data: bytes):
        if len(data) < 12 or data[:4] != b"TBD1":
            raise ValueError("not a word graph")
        self.states, self.size = (int.from_bytes(data[k : k + 4], "little") for k in (4, 8))
        self.final, self.edges, at = [], [], 12
        for _ in range(self.states):
            if at >= len(data):
                raise ValueError("the word graph is cut short")
            n, final = data[at] & 127, bool(data[at] & 128)
            at += 1
            if at + 4 * n > len(data):
                raise ValueError("the word graph is cut short")
            self.final.append(final)
            self.edges.append({chr(int.from_bytes(data[k : k + 2], "little")): int.from_bytes(data[k + 2 : k + 4], "little") for k in range(at, at + 4 * n, 4)})
            at += 4 * n

    def words(self) -> list[str]:
        found, todo = [], [(0, "")]
        while todo:
            state, word = todo.pop()
            if self.final[state]:
                found.append(word)
            todo += [(to, word + c) for c, to in self.edges[state].items()]
        return sorted(found)

    def __contains__(self, word: str) -> bool:
        state = 0
        for c in word:
            state = self.edges[state].get(c, -1)
            if state < 0:
                return False
        return self.final[state]


def read_dawg(spark: SparkSession, path: str) -> list[str]:
    """The words of a binary word graph."""
    return Dawg(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])).words()
