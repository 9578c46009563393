"""Token filters: columns of token arrays in, columns of token arrays out.

With `keep` a filter puts its variant after the token, at the same place (position
increment 0, same offsets and position length); without it the variant takes the
token's place.  Filters are native expressions except where noted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanna.functions import scalar
from lanna.operators.normalize import normalize
from lanna.operators.numbers import merge_numbers
from lanna.operators.romanize import romanize

TOKEN = "struct<term:string,start:int,end:int,pos_inc:int,pos_len:int,type:string>"
TOKENS = f"array<{TOKEN}>"
#: Tokens of this type keep their spelling.
KEYWORD = "<KEYWORD>"
FIELDS = ("term", "start", "end", "pos_inc", "pos_len", "type")


def with_fields(token: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(f, token[f]).alias(f) for f in FIELDS])


def variants(tokens: Column, make: Callable[[Column], Column], kind: str, keep: bool) -> Column:
    """Adds or puts in the variant of each token; no variant where `make` gives null or the term itself."""

    def one(t: Column) -> Column:
        other = make(t)
        new = with_fields(t, term=other, type=F.lit(kind), **({"pos_inc": F.lit(0)} if keep else {}))
        return F.when(other.isNotNull() & (other != t["term"]) & (other != ""), F.array(t, new) if keep else F.array(new)).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one))


#: What a Python function holds at once: characters of texts, or tokens times this; a batch has 10,000 rows of any size.
AT_ONCE, TOKEN_SIZE = 1 << 19, 8


def portions(column: pa.Array) -> Iterator[pa.Array]:
    """A batch of texts or of token lists in slices of bounded size, so that a worker's memory doesn't grow with its rows; a row that is longer is a slice."""
    listed = pa.types.is_list(column.type)
    sizes = (pc.list_value_length(column) if listed else pc.binary_length(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes * (TOKEN_SIZE if listed else 1) + TOKEN_SIZE)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield column.slice(at, end - at)
        at = end


def once(column: pa.Array, make: Callable[[list], pa.Array]) -> pa.Array:
    """`make` of a column's values; equal values of it are made once."""
    known = column.dictionary_encode()
    made = make(known.dictionary.to_pylist())
    return made if len(made) == len(column) else made.take(known.indices)


def running(kind: str) -> Callable[[Column], Column]:
    """A vectorized function over arrays of int: `sum`, the running sums of each; or `carry`, of each place the last value above 0 before it, else -1."""

    def values(column: pa.Array) -> pa.Array:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)  # null arrays give empty ones
        starts = np.cumsum(lengths) - lengths
        if kind == "sum":
            sums = np.concatenate([[0], np.cumsum(flat)])
            out = sums[1:] - np.repeat(sums[starts], lengths)  # less what came before the row
        else:
            at = np.arange(len(flat))
            last = np.concatenate([[-1], np.maximum.accumulate(np.where(flat > 0, at, -1))])[:-1] if len(flat) else at
            out = np.where(last >= np.repeat(starts, lengths), flat[last], -1) if len(flat) else flat
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(out.astype(np.int32)))

    @F.arrow_udf("array<int>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield from map(values, portions(column))

    return apply


def outside_compounds(tokens: Column) -> Column:
    """Tokens with a field `inside`: whether they lie in the span of the last compound, a token of position length above 1, before them."""
    ends = running("carry")(F.transform(tokens, lambda t: F.when(t["pos_len"] > 1, t["end"]).otherwise(0)))
    return F.zip_with(tokens, ends, lambda t, end: F.struct(t.alias("t"), ((t["pos_len"] <= 1) & (t["start"] < end)).alias("inside")))


def _guarded(tokens: Column, make: Callable[[Column], Column], kind: str, keep: bool, compounds: bool) -> Column:
    if not compounds:
        return variants(tokens, make, kind, keep)

    def one(x: Column) -> Column:
        t = x["t"]
        other = F.when(~x["inside"], make(t))
        new = with_fields(t, term=other, type=F.lit(kind), **({"pos_inc": F.lit(0)} if keep else {}))
        return F.when(other.isNotNull() & (other != t["term"]) & (other != ""), F.array(t, new) if keep else F.array(new)).otherwise(F.array(t))

    return F.flatten(F.transform(outside_compounds(tokens), one))


def keyboard(tokens: Column, way: str | None = None, keep: bool = True, least: int = 1) -> Column:
    """What a term would be on the other keyboard layout; `both` picks the way by the term's script."""
    way = scalar.direction(way)

    def make(t: Column) -> Column:
        there, back = scalar.to_kedmanee(t["term"]), scalar.to_qwerty(t["term"])
        other = there if way == scalar.FORWARD else back if way == scalar.BACKWARD else F.when(scalar.contains_thai(t["term"]), back).otherwise(there)
        return F.when(F.octet_length(F.encode(t["term"], "UTF-16BE")) >= 2 * max(1, least), other)  # UTF-16 units

    return variants(tokens, make, "<KEYBOARD_CORRECTED>", keep)


def soundex(tokens: Column, keep: bool = True, least: int = 3, compounds: bool = True) -> Column:
    """Phonetic codes of Thai terms that don't lie in a compound; without compounds in the stream the guard can be left out."""
    make = lambda t: F.when(scalar.contains_thai(t["term"]) & (F.length(t["term"]) >= max(1, least)), scalar.soundex(t["term"]))
    return _guarded(tokens, make, "<PHONETIC>", keep, compounds)


def tone(tokens: Column, keep: bool = True, tones: bool = True, thanthakhat: bool = True, compounds: bool = True) -> Column:
    make = lambda t: F.when(scalar.contains_thai(t["term"]), scalar.strip_tones(t["term"], tones, thanthakhat))
    return _guarded(tokens, make, "<TONE_STRIPPED>", keep, compounds)


class Steps:
    """Filters in Python: functions from a list of tokens to another.  Steps that follow one another in a chain cross to Python once."""

    def __init__(self, *steps: Callable[[list[tuple]], list[tuple]]):
        self.steps = steps

    def rows(self, tokens: list[tuple]) -> list[tuple]:
        for step in self.steps:
            tokens = step(tokens)
        return tokens

    def __call__(self, column: Column) -> Column:
        rows = self.rows

        def changed(tokens: pa.Array) -> pa.Array:
            flat, at, out = list(zip(*(x.to_pylist() for x in tokens.flatten().flatten()))), 0, []
            for n in pc.list_value_length(tokens).to_pylist():
                out.append(None if n is None else rows(flat[at : at + n]))
                at += n or 0
            return token_arrays(out)

        @F.arrow_udf(TOKENS)
        def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for tokens in batches:
                yield from map(changed, portions(tokens))

        return apply(column)


_FIELD_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())


def token_arrays(rows: list[list[tuple] | None]) -> pa.Array:
    """Lists of tokens as an Arrow array, field by field."""
    flat = [t for own in rows if own for t in own]
    columns = zip(*flat) if flat else [()] * len(FIELDS)
    fields = [pa.array(np.fromiter(x, np.int32, len(flat))) if kind == pa.int32() else pa.array(x, kind) for x, kind in zip(columns, _FIELD_TYPES)]
    ends = np.concatenate([[0], np.cumsum([len(x or ()) for x in rows], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, FIELDS), mask=pa.array([x is None for x in rows]))


def number(keep: bool = True, digits: bool = True, words: bool = True, least: int = 0) -> Steps:
    """Thai digits and runs of adjoining number words as ASCII numbers; in Python, as runs merge tokens."""
    return Steps(lambda tokens: merge_numbers(tokens, keep, digits, words, least))


def normalization() -> Steps:
    """Canonical spelling of every term but those of `keyword` type; in Python, as marks move step by step."""
    return Steps(lambda tokens: [t if t[5] == KEYWORD else (normalize(t[0]), *t[1:]) for t in tokens])


def romanization(keep: bool = True, table: dict[str, tuple[str, ...]] | None = None) -> Steps:
    """All Latin spellings of a term; without `keep` the first takes its place and the others follow.  `table`: see `load_spellings`."""

    def spell(rows: list[tuple]) -> list[tuple]:
        out = []
        for r in rows:
            made = [x for x in romanize(r[0], table) if x != r[0]]
            if keep or not made:
                out.append(r)
            out += [(x, r[1], r[2], r[3] if not keep and k == 0 else 0, r[4], "<ROMANIZATION>") for k, x in enumerate(made)]
        return out

    return Steps(spell)


def acronym(tokens: Column, keep: bool = True, both_ways: bool = False, normalize_dots: bool = True, table: list[tuple[str, str]] | None = None) -> Column:
    """Expansions of short forms, also of those written without full stops, and with `both_ways` short forms of expansions; maps as literals.  `table`: see `load_short_forms`."""
    forms = short_forms(table)
    as_map = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    exact, dotless, back = map(as_map, forms)

    def make(t: Column) -> Column:
        found = exact[t["term"]]
        if normalize_dots:
            found = F.coalesce(found, dotless[F.regexp_replace(t["term"], "[.ฯ]", "")])
        return F.coalesce(found, back[t["term"]]) if both_ways else found

    return variants(tokens, make, "<ACRONYM_EXPANDED>", keep)


def short_forms(table: list[tuple[str, str]] | None = None) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Maps from short forms, from short forms without stops, and from expansions; of equal ones the last, the last and the first counts."""
    from lanna.sources.dictionary import abbreviation_rows

    rows = abbreviation_rows() if table is None else table
    exact = dict(rows)
    back: dict[str, str] = {}
    for short, full in rows:
        back.setdefault(full, short)
    return exact, {short.replace(".", "").replace("ฯ", ""): full for short, full in rows}, back


def collation(tokens: Column, strength: str = "tertiary", decomposition: str = "none") -> Column:
    return F.transform(tokens, lambda t: with_fields(t, term=scalar.collation_key(t["term"], strength, decomposition)))


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: with_fields(t, term=scalar.lower(t["term"])))


def stop(tokens: Column, words: list[str]) -> Column:
    """Without the stop words; a token's position increment takes those of the ones dropped before it."""
    banned = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    placed = F.zip_with(tokens, running("sum")(F.transform(tokens, lambda t: t["pos_inc"])), lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    kept = F.filter(placed, lambda x: ~F.array_contains(banned, x["t"]["term"]))
    before = F.concat(F.array(F.lit(0)), F.transform(kept, lambda x: x["p"]))  # one longer; the last is left over
    steps = F.zip_with(kept, before, lambda x, p: F.struct(x.alias("x"), p.alias("p")))
    return F.transform(F.filter(steps, lambda s: s["x"].isNotNull()), lambda s: with_fields(s["x"]["t"], pos_inc=s["x"]["p"] - s["p"]))
