"""Exact, cached encoding of whole texts with the `tokenizers` library.

Texts are cut only at places where the vocabulary's own pre-tokenizer always
cuts, so encoding the units one by one gives the ids of the whole text.  Units
repeat heavily, hence each worker keeps a bounded table unit -> ids.  New units are
encoded many at a time, as one text in which blanks, line feeds or bars part them;
the ids that begin with such a sign tell where a unit's own ids are.  A word with
signs after it is the word's ids and the signs'.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lanna.llm.common import take_turn

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: White space other than blanks and line feeds, and what Python but not Unicode's White_Space counts as such.
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD = re.compile("[\x1c-\x1f]")
_UNIT = re.compile(r"\s*\S+|\s+")
_SOLID = re.compile(r"\S+")
#: Keys of units: a plain key has a blank before it, the others begin with one of these.
_AS_IS, _LINE = "\x1c", "\x1d"
#: Signs after a word, which pre-tokenizers part from it; no apostrophe.
_SIGNS = ".,;:!?)]}\"-/"
#: Letters and digits that stay such by themselves whatever a vocabulary's normalizer does; Latin ones suffice.
_ENDS = frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and c.lower()[-1].isalnum())
#: Units that are encoded in one text, and what stands between them there if white space makes no ids.
CHUNK = 128
_BAR = "\x7f"
#: Longer texts aren't put into Arrow's arrays.
LONG = 1 << 26
#: A unit that was met so often since the table was last shortened stays in it.
_OFTEN = 3


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Index(dict):
    """Numbers units as they come and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class UnitEncoder:
    """Encodes lists of texts; `spaces` tells whether white space makes ids (byte-level) or only separates (word-level)."""

    def __init__(self, path: str, spaces: bool, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._spaces, self._limit, self.size = spaces, limit, self._tokenizer.get_vocab_size()
        names = self._tokenizer.get_vocab()
        # Letters are one word for every pre-tokenizer, so the vocabulary's model takes them without it; letters beyond ASCII only if nothing normalizes them.
        self._bytes = spaces and self._tokenizer.normalizer is None
        self._letters = Tokenizer(self._tokenizer.model)
        self._letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self._letters.model._resize_cache(0)  # each new word comes once
        self._ends = np.zeros(max(names.values(), default=0) + 1, bool)
        self._ends[[n for name, n in names.items() if name.endswith("</w>")]] = True
        self._begins = {sign: np.zeros(max(names.values(), default=0) + 1, bool) for sign in (" ", "\n", _BAR)}
        for sign, mark in ((" ", "\u0120"), ("\n", "\u010a")):  # how byte-level vocabularies write a blank and a line feed
            self._begins[sign][[n for name, n in names.items() if name[0] == mark]] = True
        self._begins[_BAR][self._direct([_BAR])[0]] = True
        self._clear()

    def _clear(self) -> None:
        self._index = _Index()
        self._start, self._count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where a unit's ids are in _ids
        self._ids = np.zeros(0, np.uint32)
        self._seen = np.zeros(0, np.int64)

    def _shorten(self) -> None:
        """Drops the units that were met seldom, so that the table stays bounded."""
        keep = np.flatnonzero(self._seen >= _OFTEN)
        if len(keep) > self._limit // 2:
            keep = keep[np.argsort(-self._seen[keep], kind="stable")[: self._limit // 2]]
        names = [*self._index]
        ids, ends = self._gathered(keep)
        counts = self._count[keep]
        self._clear()
        for k in keep.tolist():
            self._index[names[k]] = len(self._index)
        self._ids, self._start, self._count, self._seen = ids, ends - counts, counts, np.zeros(len(keep), np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words of letters, each after a blank."""
        flat, counts = [], []
        mark = "\u0120" if self._spaces else ""
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS) for w in words]
        texts = [mark + f" {mark}".join(spelled[k : k + CHUNK]) for k in range(0, len(words), CHUNK)]
        for k, e in enumerate(self._letters.encode_batch_fast(texts if self._spaces else [*map(str.lower, texts)], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            if self._spaces:
                n = np.diff(np.flatnonzero(self._begins[" "][ids]), append=len(ids))
            else:
                n = np.diff(np.flatnonzero(self._ends[ids]), prepend=-1)
            own = words[k * CHUNK : (k + 1) * CHUNK]
            if len(n) != len(own) or n.sum() != len(ids):  # a vocabulary without such marks
                each = self._direct([" " + w for w in own])
                ids, n = np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
            flat.append(ids)
            counts.append(n)
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _line(self, text: str) -> str | None:
        """A text whose units' keys are parted by single blanks, if that is so simple."""
        if not text or len(text) > LONG or _OTHER.search(text):
            return None
        if not self._spaces:
            return text.replace("\n", " ")
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return None
        return _AS_IS + text.replace("\n", " " + _LINE)

    def _keys(self, text: str) -> list[str]:
        """Keys of any other text's units."""
        if not self._spaces:
            return text.split()
        return [u[1:] if u[0] == " " and not u[1:2].isspace() and len(u) > 1 else _AS_IS + u for u in _UNIT.findall(text)]

    def _units(self, lines: list[str]) -> list[np.ndarray]:
        """Numbers of the units of lines; each different unit is looked up once."""
        words = pc.split_pattern(pa.array(lines, pa.string()), " ")
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        coded = words.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        empty = keys.index("") if not self._spaces and "" in keys else -1
        if empty >= 0:
            keys[empty] = "a"  # any word; it is left out below
        numbers = np.fromiter(map(self._index.__getitem__, keys), np.int64, len(keys))
        if empty >= 0:
            numbers[empty] = -1
        numbers = numbers[coded.indices.to_numpy()]
        own = np.split(numbers, ends[:-1]) if len(lines) else []
        return [x[x >= 0] for x in own] if empty >= 0 else own

    def _parted(self, units: list[str], sign: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, each with `sign` before it, and their counts."""
        flat, counts, between = [], [], sign if self._spaces else f" {sign} "
        chunks = [units[k : k + CHUNK] for k in range(0, len(units), CHUNK)]
        for own, ids in zip(chunks, self._direct([between + between.join(x) for x in chunks])):
            ids = np.array(ids, np.uint32)
            at = np.flatnonzero(self._begins[sign][ids])
            if len(at) != len(own) or at[0]:  # the vocabulary joins the sign with something else
                each = self._direct([between + u for u in own])
                ids, n = np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(own))
            else:
                n = np.diff(at, append=len(ids))
            flat.append(ids)
            counts.append(n)
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self) -> None:
        """Adds the ids of the units that the index met for the first time."""
        index = self._index
        groups: dict[str, tuple[list[int], list[str]]] = {kind: ([], []) for kind in ("a", " ", "\n", _AS_IS, _BAR, "")}
        plain_at, plain = groups["a"]
        joined: list[tuple[int, int, int]] = []
        first = len(index) - len(index.new)
        for k, key in enumerate(index.new, first):  # grows by the parts of units
            if key.isalpha() and (self._bytes or key.isascii()):
                plain_at.append(k)
                plain.append(key)
                continue
            if key[-1] in _SIGNS and (bare := key.rstrip(_SIGNS))[-1:] in _ENDS:
                joined.append((k, index[bare], index[_AS_IS + key[len(bare) :] if self._spaces else key[len(bare) :]]))
                continue
            if not self._spaces:
                kind, unit = "" if _BAR in key else _BAR, key
            elif key[0] == _LINE:
                kind, unit = "\n", key[1:]
            elif key[0] == _AS_IS:
                kind, unit = (_AS_IS if _SOLID.fullmatch(key, 1) else ""), key[1:]
            else:
                kind, unit = " ", key
            groups[kind][0].append(k)
            groups[kind][1].append(unit)
        index.new = []
        more = np.zeros(len(index) - first, np.int64)
        self._start, self._count = np.concatenate([self._start, more]), np.concatenate([self._count, more])
        ids, at = [self._ids], len(self._ids)
        for kind, (places, units) in groups.items():
            if not units:
                continue
            if kind == "a":
                flat, counts = self._words(units)
            elif kind:
                flat, counts = self._parted(units, "\n" if kind == _AS_IS else kind)
                if kind in (_AS_IS, _BAR):  # these units have no sign of their own
                    flat, counts = np.delete(flat, np.cumsum(counts) - counts), counts - 1
            else:
                each = self._direct(units)
                flat, counts = np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
            ids.append(flat)
            self._start[places], self._count[places] = at + np.cumsum(counts) - counts, counts
            at += len(flat)
        self._ids = np.concatenate(ids)
        if joined:
            of = np.array(joined, np.int64)
            flat, ends = self._gathered(of[:, 1:].ravel())
            self._count[of[:, 0]] = self._count[of[:, 1]] + self._count[of[:, 2]]
            self._start[of[:, 0]] = at + ends[1::2] - self._count[of[:, 0]]
            self._ids = np.concatenate([self._ids, flat])

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after another, and where each unit's end."""
        counts = self._count[at]
        ends = np.cumsum(counts)
        return self._ids[np.repeat(self._start[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], ends

    def encode(self, texts: list[str], tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's count; `tail` is put after each text."""
        take_turn("tokens", self._clear)
        if len(self._index) > self._limit:
            self._shorten()
        direct, at, lines = {}, [np.zeros(0, np.int64)] * len(texts), {}
        for k, text in enumerate(texts):
            line = self._line(text)
            if line is not None:
                lines[k] = line
            elif _ODD.search(text):
                direct[k] = np.asarray(self._direct([text])[0], np.uint32)
            else:
                own = self._keys(text)
                at[k] = np.fromiter(map(self._index.__getitem__, own), np.int64, len(own))
        for k, own in zip(lines, self._units([*lines.values()])):
            at[k] = own
        counts = [*map(len, at)]
        if self._index.new:
            self._learn()
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self._seen = np.pad(self._seen, (0, len(self._index) - len(self._seen)))
        self._seen += np.bincount(at, minlength=len(self._seen))
        flat, ends = self._gathered(at)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])]
        if tail is None and not direct:
            return flat, np.diff(bounds)
        end = np.full(0 if tail is None else 1, tail or 0, np.uint32)
        parts = []
        for k in range(len(texts)):
            parts += [direct.get(k, flat[bounds[k] : bounds[k + 1]]), end]
        sizes = np.fromiter((len(x) + len(end) for x in parts[::2]), np.int64, len(texts))
        return np.concatenate(parts) if parts else flat, sizes


@lru_cache(4)
def encoder(path: str, spaces: bool) -> UnitEncoder:
    """One encoder a worker process and vocabulary."""
    return UnitEncoder(path, spaces)
