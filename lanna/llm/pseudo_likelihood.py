"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both sides.

Tokens are words (lower case) and signs.  The vocabulary has the most frequent words
of the whole corpus, counted in Spark; other words fall into buckets by their last
letters, so that every token has an id below VOCABULARY.  The network averages
nothing and masks the token itself: the embeddings of SIDE tokens left and right make
a hidden layer of rectified units, and two softmaxes give a class and a word
within it (classes are runs of equal size in order of frequency).  A word in
a bucket has the bucket's probability times its share of the bucket's occurrences in
the corpus, smoothed by SMOOTH; the shares of the COMMON next words are looked up in the
tasks, those of all others come from a join with the word counts.  A document's score
is the sum of the conditional log-probabilities of all its tokens.

Texts are cut into tokens once, into blocks: some documents' tokens as numbers of the block's
own list of words.  Counting, training and scoring read blocks and look up each word once a block.

Training is data-parallel: each round, every shard of the documents, all of which are
used, trains a copy of the network, and Spark averages the copies, weighed by tokens.
Documents are dealt to shards by a hash of text and id, and sorted by it, and the number of
shards follows from the corpus's tokens, so scores don't depend on how the input is split.  So what is gathered, word counts and copies,
grows with the input; what is broadcast, one network and the common words, is of fixed size.

Defined results: null or empty text has no tokens and score 0, its mean is null; null
doc_ids stay null; repeated rows count repeatedly; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.llm.common import bounded_batches, slices, table, texts_of, written

VOCABULARY = 1024
SUFFIXES = 512
CLASSES = 32
SIDE = 3
WIDTH, HIDDEN = 12, 32
ROUNDS = 2
BATCH = 512
RATE = 0.15
FLUSH = 200_000
COMMON = 20_000
#: Batches that are laid out together, and blocks in a file (Spark's reader may hold a file's blocks at once).
STEPS, BLOCKS = 64, 16
PARTS, GROUP = 16, 64
#: A shard has about so many tokens.
SHARD_TOKENS = 4_000_000
SMOOTH = 0.5

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
PAD = VOCABULARY  # an embedding for places beyond a text's ends; never predicted


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def suffix(word: str) -> int:
    """The bucket of a rare word."""
    return zlib.crc32(f"{min(len(word), 12)}:{word[-2:]}".encode("utf-8", "surrogatepass")) % SUFFIXES


_NONE, _WORD, _SIGN, _REST, _NEW = range(5)  # a byte is of no token, of a word, a sign's first, a sign's further one; not looked up yet


def _kind(char: str) -> int:
    return _NONE if char.isspace() else _WORD if char.isalnum() else _SIGN


_ASCII = bytes(_kind(chr(k)) if k < 128 else _NONE for k in range(256))
_KINDS = np.full(0x110000, _NEW, np.uint8)


def _kinds(joined: bytes) -> np.ndarray:
    """The kind of every byte."""
    kinds, raw = np.frombuffer(bytearray(joined).translate(_ASCII), np.uint8), np.frombuffer(joined, np.uint8)
    at = np.flatnonzero(raw >= 0xC0)
    if len(at):
        first = raw[at].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        further = [np.flatnonzero(size > k) for k in range(1, 4)]
        code = first & (0x7F >> size)
        for k, own in enumerate(further, 1):
            code[own] = code[own] << 6 | raw[at[own] + k] & 0x3F
        found = _KINDS[code]
        for k in np.unique(code[found == _NEW]).tolist():
            _KINDS[k] = _kind(chr(k))
        kinds[at] = found = _KINDS[code]
        found = np.where(found == _SIGN, np.uint8(_REST), found)
        for k, own in enumerate(further, 1):
            kinds[at[own] + k] = found[own]
    return kinds


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many tokens each text has, the tokens of all as numbers of words, and the words: `tokens` for many texts at once."""
    lines = [t.lower().encode() for t in texts]
    joined = b"\n".join(lines)  # a token never goes beyond a line
    kinds = _kinds(joined)
    begins = kinds == _WORD
    begins[1:] &= kinds[:-1] != _WORD
    begins |= kinds == _SIGN
    kept = kinds != _NONE
    offsets = np.append(np.flatnonzero(begins[kept]), np.count_nonzero(kept))
    every = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.frombuffer(joined, np.uint8)[kept])).dictionary_encode()
    ends = np.cumsum([len(x) + 1 for x in lines])
    sizes = np.diff(np.searchsorted(np.flatnonzero(begins), ends), prepend=0)
    return sizes, every.indices.to_numpy(), every.dictionary


_BLOCK = {"words": pa.string(), "counts": pa.binary(), "numbers": pa.binary(), "sizes": pa.binary(), "keys": pa.binary(), "doc_ids": pa.list_(pa.int64())}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keys = texts_of(batch), batch.column("key").to_numpy()
        for a, b in slices(batch, [*map(len, texts)]):
            sizes, numbers, words = cut(texts[a:b])
            counts = np.bincount(numbers, minlength=len(words))
            row = ["\n".join(words.to_pylist()), counts.astype(np.int64).tobytes(), numbers.astype(np.uint16 if len(words) <= 1 << 16 else np.int32).tobytes(), sizes.astype(np.int64).tobytes(), keys[a:b].tobytes(), batch.column("doc_id")[a:b].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _BLOCK.values())], [*_BLOCK])


def blocks(docs: DataFrame) -> DataFrame:
    """The documents' tokens, a row for about two million characters: different words, how often each occurs, and by document the tokens
    as numbers of words, how many these are, a hash of text and id, and the id."""
    keyed = docs.select("text", F.xxhash64("text", *[c for c in docs.columns if c == "doc_id"]).alias("key"), F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id"))
    return written(keyed.mapInArrow(_cut, "words string, counts binary, numbers binary, sizes binary, keys binary, doc_ids array<long>"), per_file=BLOCKS)


def _opened_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Of every block its words, their numbers by token, the tokens by document, and its row."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            words, raw, sizes = (row.column(c)[0].as_py() for c in ("words", "numbers", "sizes"))
            sizes = np.frombuffer(sizes, np.int64)
            yield words.split("\n") if words else [], np.frombuffer(raw, np.int32 if len(raw) == 4 * sizes.sum() else np.uint16), sizes, row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = [*seen.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    for batch in batches:
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
            for word, n in zip(words.split("\n") if words else (), np.frombuffer(counts, np.int64).tolist()):
                seen[word] += n
            if len(seen) > FLUSH:
                yield out()
    yield out()


class Vocabulary(dict):
    """Ids of tokens; the ids are ordered by frequency, and a rare word gets its bucket's.

    `common` has the smoothed log counts of the most frequent words in buckets, `totals` for every id the log of its bucket's smoothed
    count (0 where the id is a word's own), and `counts`, which stays on the driver, the counts of all words.
    """

    def __init__(self, words: dict[str, int], buckets: list[int], common: dict[str, float], totals: np.ndarray, counts: DataFrame | None = None, size: int = 0):
        super().__init__(words)
        self.size = size  # tokens of the corpus
        self.buckets, self.common, self.totals, self.counts, self.endings = buckets, common, totals, counts, {}
        self.shared = np.zeros(VOCABULARY, bool)
        self.shared[buckets] = True

    def __missing__(self, word: str) -> int:
        return self.buckets[suffix(word)]

    def __reduce__(self):
        return Vocabulary, (dict(self), self.buckets, self.common, self.totals)

    def looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every word its id, the log of its share of its bucket (0 where the id is its own), and whether the share still lacks the word's log count."""
        ids = np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))
        others = np.flatnonzero(ids < 0)
        some = [words[k] for k in others.tolist()]
        endings = [(len(w) if len(w) < 12 else 12, w[-2:]) for w in some]  # all that `suffix` reads
        if len(self.endings) > FLUSH:
            self.endings.clear()
        for word, ending in zip(some, endings):
            if ending not in self.endings:
                self.endings[ending] = self[word]
        ids[others] = [*map(self.endings.__getitem__, endings)]
        shared = self.shared[ids]
        logs = np.array([*map(self.common.get, words)], float)  # None becomes nan
        rare = shared & np.isnan(logs)
        return ids, np.where(shared & ~rare, logs, 0) - self.totals[ids], rare


def _bucket_counts(batches: Iterator[pa.RecordBatch], known: frozenset) -> Iterator[pa.RecordBatch]:
    n, types = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for batch in batches:
        for word, k in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            if word not in known:
                n[suffix(word)] += k
                types[suffix(word)] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUFFIXES)), pa.array(n), pa.array(types)], ["bucket", "n", "types"])


def vocabulary(docs: DataFrame) -> Vocabulary:
    return _vocabulary(blocks(docs))


def _vocabulary(cut_docs: DataFrame) -> Vocabulary:
    """From the counts of all words: the most frequent ones and the buckets, numbered by falling frequency."""
    counts = written(cut_docs.select("words", "counts").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - SUFFIXES + COMMON).collect()
    known = {r["word"]: r["n"] for r in top[: VOCABULARY - SUFFIXES]}
    common = {r["word"]: float(np.log(r["n"] + SMOOTH)) for r in top[VOCABULARY - SUFFIXES :]}
    rows = counts.mapInArrow(partial(_bucket_counts, known=frozenset(known)), "bucket long, n long, types long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    buckets = {r["bucket"]: r["n"] for r in rows}
    order = sorted([*((-n, 0, w) for w, n in known.items()), *((-buckets.get(b, 0), 1, b) for b in range(SUFFIXES))], key=lambda x: (x[0], x[1], str(x[2])))
    words, places, totals = {}, [0] * SUFFIXES, np.zeros(VOCABULARY)
    for k, (_, is_bucket, x) in enumerate(order):
        if is_bucket:
            places[x] = k
        else:
            words[x] = k
    for r in rows:  # one more word in each bucket stands for words that were not counted
        totals[places[r["bucket"]]] = np.log(r["n"] + SMOOTH * (r["types"] + 1))
    return Vocabulary(words, places, common, totals, counts, sum(known.values()) + sum(buckets.values()))


SHAPES = {
    "embedding": (VOCABULARY + 1, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "inner_bias": (HIDDEN,),
    "class": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "word": (CLASSES, HIDDEN, VOCABULARY // CLASSES), "word_bias": (CLASSES, VOCABULARY // CLASSES),
}
_CUTS = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])
_SHIFTS = [k for k in range(-SIDE, SIDE + 1) if k]


def start() -> np.ndarray:
    """A network's numbers, one after another."""
    rng = np.random.default_rng(1)
    parts = []
    for name, shape in SHAPES.items():
        scale = 0.0 if name.endswith("bias") else 0.1 if name == "embedding" else 1 / np.sqrt(shape[-2])
        parts.append((rng.standard_normal(shape) * scale).ravel())
    return np.concatenate(parts).astype(np.float32)


def opened(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {name: flat[a:b].reshape(shape) for (name, shape), a, b in zip(SHAPES.items(), _CUTS, _CUTS[1:])}


def contexts(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of some texts' token ids the ids around each, padded at the texts' ends."""
    at = np.arange(SIDE, SIDE + len(ids)) + np.repeat(np.arange(len(sizes)) * SIDE, sizes)
    flat = np.full(len(ids) + SIDE * (len(sizes) + 1), PAD, np.int32)
    flat[at] = ids
    return np.stack([flat[at + k] for k in _SHIFTS], axis=1)


def _forward(net: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = net["embedding"].take(around, axis=0).reshape(len(around), -1)
    h = x @ net["inner"]
    h += net["inner_bias"]
    return x, np.maximum(h, 0, out=h)


def _bounded(z: np.ndarray) -> np.ndarray:
    """`z`, its rows shifted to a maximum of 0 where numbers are large, so that sums of exponentials are finite and not 0."""
    if not (z.max() < 40 and z.min() > -40):
        z -= z.max(axis=1, keepdims=True)
    return z


def _sums(e: np.ndarray) -> np.ndarray:
    return e @ np.ones(e.shape[1], e.dtype)


_PER = VOCABULARY // CLASSES


_CHUNK = 1024


def log_probabilities(net: dict[str, np.ndarray], target: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Of every token, given those around it."""
    out = np.empty(len(target), np.float64)
    order = np.argsort((target // _PER).astype(np.uint8), kind="stable")  # tokens of a class stand together
    for k in range(0, len(order), _CHUNK):
        own = order[k : k + _CHUNK]
        group, within = np.divmod(target[own], _PER)
        each = np.arange(len(own))
        _, h = _forward(net, around[own])
        ends = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        z = np.empty((len(own), _PER), h.dtype)
        for c in range(group[0], group[-1] + 1):
            i, j = ends[c], ends[c + 1]
            if i < j:
                np.matmul(h[i:j], net["word"][c], out=z[i:j])
                z[i:j] += net["word_bias"][c]
        y = h @ net["class"]
        y += net["class_bias"]
        logs = _bounded(y)[each, group] + _bounded(z)[each, within]
        out[own] = logs - np.log(_sums(np.exp(y, out=y))) - np.log(_sums(np.exp(z, out=z)))
    return out


_PAIRS = np.arange((VOCABULARY + 1) * (WIDTH // 2)).reshape(VOCABULARY + 1, -1)


def descend(net: dict[str, np.ndarray], target: np.ndarray, around: np.ndarray, rate: float, order: np.ndarray, size: int = BATCH) -> None:
    """Gradient descent on the mean log-loss of batches of `size` tokens, taken in some order, one after another.

    Within a batch, rows of a class stand together.  Classes with at most `most` rows are multiplied at once, each filled up
    to `most` rows with zeros, the others one by one.
    """
    n, n_batches = len(order), -(-len(order) // size)
    target = target.take(order)
    key = target // _PER + np.repeat(np.arange(n_batches, dtype=target.dtype) * CLASSES, size)[:n]
    own = np.argsort(key.astype(np.uint16) if n_batches <= STEPS else key, kind="stable")
    target, around, counts = target.take(own), around.take(order.take(own), axis=0), np.bincount(key, minlength=n_batches * CLASSES)
    group, within = target // _PER, target % _PER
    most = max(1, size * 5 // 4 // CLASSES)
    # Where each class's rows begin in order, in the batch, and in the filled-up classes; those of a class that doesn't fit are elsewhere.
    begins = np.cumsum(counts) - counts
    in_batch = begins - np.repeat(np.arange(n_batches) * size, CLASSES)
    places = np.arange(most)
    of_batch = np.minimum(size, n - np.arange(n_batches) * size).repeat(CLASSES)[:, None]  # a row of zeros follows a batch's tokens
    filled = np.where(places < np.where(counts <= most, counts, 0)[:, None], in_batch[:, None] + places, of_batch).reshape(n_batches, -1)
    slot = np.arange(n) + np.repeat(np.tile(np.arange(CLASSES) * most, n_batches) - begins, counts)  # of rows that don't fit, anything
    room = _room(min(size, n), most, net["inner"].dtype)
    for b, (own, first) in enumerate(zip(counts.reshape(n_batches, CLASSES), in_batch.reshape(n_batches, CLASSES))):
        rows = slice(b * size, min(n, (b + 1) * size))
        _step(net, room, group[rows], within[rows], around[rows], rate, slot[rows], filled[b], [(c, first[c], first[c] + own[c]) for c in np.flatnonzero(own > most).tolist()])


def train_step(net: dict[str, np.ndarray], target: np.ndarray, around: np.ndarray, rate: float) -> None:
    """One step of gradient descent on a batch's mean log-loss."""
    descend(net, target, around, rate, np.arange(len(target)), len(target))


def _room(n: int, most: int, kind: np.dtype) -> dict[str, np.ndarray]:
    """Arrays that the steps on batches of up to `n` tokens write to; new ones for each step cost more than some of the products."""
    shapes = {"x": (n, 2 * SIDE, WIDTH), "h": (n + 1, HIDDEN), "z": (2 * n + 1, _PER), "back": (n, HIDDEN), "more": (n, HIDDEN), "to_x": (n, 2 * SIDE * WIDTH)}
    shapes |= {"tiles": (CLASSES, most, HIDDEN), "of_tiles": (CLASSES, most, _PER), "product": (CLASSES, most, _PER), "returned": (CLASSES, most, HIDDEN), "steps": (CLASSES, HIDDEN, _PER)}
    return {k: np.empty(x, kind) for k, x in shapes.items()} | {"pairs": np.empty((n, 2 * SIDE, WIDTH // 2), np.int64), "ones": np.ones(n, kind)}


def _step(net: dict[str, np.ndarray], room: dict[str, np.ndarray], group: np.ndarray, within: np.ndarray, around: np.ndarray, rate: float, slot: np.ndarray, filled: np.ndarray, runs: list[tuple[int, int, int]]) -> None:
    """A step on rows that `descend` has laid out; gradients carry the rate from the softmaxes on."""
    n, kind = len(group), net["inner"].dtype
    scale, word, ones = kind.type(rate / n), net["word"], room["ones"][:n]
    x = net["embedding"].take(around, axis=0, out=room["x"][:n], mode="clip").reshape(n, -1)
    padded, z = room["h"][: n + 1], room["z"][: 2 * n + 1]
    padded[n], z[2 * n] = 0, 0
    h, p, q = padded[:n], z[:n], z[n : 2 * n]
    np.matmul(x, net["inner"], out=h)
    h += net["inner_bias"]
    np.maximum(h, 0, out=h)
    np.matmul(h, net["class"], out=p)
    p += net["class_bias"]
    tiles, of_tiles, flat = room["tiles"], room["of_tiles"], len(filled)
    padded.take(filled, axis=0, out=tiles.reshape(flat, -1), mode="clip")
    np.matmul(tiles, word, out=room["product"]).reshape(flat, -1).take(slot, axis=0, out=q, mode="clip")
    for c, i, j in runs:
        np.matmul(h[i:j], word[c], out=q[i:j])
    q += net["word_bias"].take(group, axis=0)
    # Both softmaxes at once, less 1 at what is there.
    both = z[: 2 * n]
    np.exp(_bounded(both), out=both)
    both *= (scale / _sums(both))[:, None]
    both.reshape(-1)[np.arange(0, both.size, _PER) + np.concatenate([group, within])] -= scale
    z[n:].take(filled, axis=0, out=of_tiles.reshape(flat, -1), mode="clip")
    back, more, steps = np.matmul(p, net["class"].T, out=room["back"][:n]), room["more"][:n], room["steps"]
    np.matmul(of_tiles, word.transpose(0, 2, 1), out=room["returned"]).reshape(flat, -1).take(slot, axis=0, out=more, mode="clip")
    np.matmul(tiles.transpose(0, 2, 1), of_tiles, out=steps)
    bias_steps = of_tiles.sum(axis=1)
    for c, i, j in runs:
        np.matmul(q[i:j], word[c].T, out=more[i:j])
        np.matmul(h[i:j].T, q[i:j], out=steps[c])
        np.matmul(ones[i:j], q[i:j], out=bias_steps[c])
    word -= steps
    net["word_bias"] -= bias_steps
    back += more
    back *= np.sign(h, out=more)
    to_x = np.matmul(back, net["inner"].T, out=room["to_x"][:n])
    net["class"] -= h.T @ p
    net["class_bias"] -= ones @ p
    net["inner"] -= x.T @ back
    net["inner_bias"] -= ones @ back
    pair = np.result_type(kind, np.complex64)  # two numbers are subtracted at once
    np.subtract.at(net["embedding"].reshape(-1).view(pair), _PAIRS.take(around, axis=0, out=room["pairs"][:n], mode="clip").reshape(-1), to_x.reshape(-1).view(pair))


def _encode(batches: Iterator[pa.RecordBatch], vocab) -> Iterator[pa.RecordBatch]:
    """The ids of each text, two bytes a token, and its key."""
    for words, numbers, sizes, row in _opened_blocks(batches):
        ids = vocab.value.looked_up(words)[0].astype(np.int16)[numbers]
        ends = np.cumsum(sizes * 2, dtype=np.int64)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(ids)])
        yield pa.RecordBatch.from_arrays([raw.cast(pa.binary()), pa.array(np.frombuffer(row.column("keys")[0].as_py(), np.int64))], ["ids", "key"])


def _train(batches: Iterator[pa.RecordBatch], now, seed: int) -> Iterator[pa.RecordBatch]:
    """Of a task PARTS rows: its tokens and a part of its network's numbers."""
    flat, seen = now.value.copy(), 0
    net, rng = opened(flat), np.random.default_rng(seed)
    for batch in batches:
        raw = batch.column("ids").to_pylist()
        for a, b in slices(batch, [*map(len, raw)], 200_000):
            target = np.frombuffer(b"".join(raw[a:b]), np.int16).astype(np.int32)
            around = contexts(target, np.array([len(x) // 2 for x in raw[a:b]]))
            order = rng.permutation(len(target))
            for k in range(0, len(order), STEPS * BATCH):
                descend(net, target, around, RATE * BATCH ** 0.5 / 4, order[k : k + STEPS * BATCH])
            seen += len(target)
    if seen:
        parts = np.array_split(flat, PARTS)
        yield pa.RecordBatch.from_arrays([pa.array([*range(PARTS)], pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "tokens", "network"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of the tasks' networks, weighed by tokens."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for part, n, raw in zip(*(batch.column(k).to_pylist() for k in ("part", "tokens", "network"))):
            weight, total = sums.get(part, (0, 0.0))
            sums[part] = weight + n, total + np.frombuffer(raw, np.float32).astype(np.float64) * n
    rows = [(part, weight, total.tobytes()) for part, (weight, total) in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.int64(), pa.binary()))], ["part", "tokens", "total"])


def train(docs: DataFrame, vocab: Vocabulary, share: int = 1, rounds: int = ROUNDS) -> np.ndarray:
    """The network after some rounds of averaging; trained on one document in `share`, or on all if these have no tokens."""
    part = docs if share == 1 else docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    network = _trained(blocks(part), vocab, max(1, -(-vocab.size // (share * SHARD_TOKENS))), rounds)
    return train(docs, vocab, 1, rounds) if network is None and share > 1 else start() if network is None else network


def _trained(cut_docs: DataFrame, vocab: Vocabulary, shards: int, rounds: int = ROUNDS) -> np.ndarray | None:
    """The network after some rounds of averaging, or none without tokens."""
    spark = cut_docs.sparkSession
    shared, now = spark.sparkContext.broadcast(vocab), start()
    encoded = cut_docs.select("words", "numbers", "sizes", "keys").mapInArrow(partial(_encode, vocab=shared), "ids binary, key long")
    encoded = encoded.repartition(shards, "key").sortWithinPartitions("key").select("ids")
    for k in range(rounds):
        copies = encoded.mapInArrow(partial(_train, now=spark.sparkContext.broadcast(now), seed=k), "part int, tokens long, network binary")
        # Copies are added up in groups of GROUP tasks, each part by itself, so no task takes whole networks of many and the driver gets few sums.
        groups = copies.withColumn("g", F.floor(F.spark_partition_id() / GROUP)).repartition("g", "part").select("part", "tokens", "network").mapInArrow(_add, "part int, tokens long, total binary").collect()
        weight = sum(r["tokens"] for r in groups if r["part"] == 0)
        if not weight:
            return None
        now = np.concatenate([sum(np.frombuffer(r["total"], np.float64) for r in groups if r["part"] == p) / weight for p in range(PARTS)]).astype(np.float32)
    return now


def _score(batches: Iterator[pa.RecordBatch], vocab, now) -> Iterator[pa.RecordBatch]:
    net = opened(now.value)
    for words, numbers, sizes, row in _opened_blocks(batches):
        of_words, shares, rare = vocab.value.looked_up(words)
        ids = of_words[numbers]
        logs = log_probabilities(net, ids, contexts(ids, sizes)) + shares[numbers]
        document = np.repeat(np.arange(len(sizes)), sizes)
        lacking = np.flatnonzero(rare[numbers])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(document[lacking], minlength=len(sizes)))), pa.int32()), pa.array(words, pa.string()).take(pa.array(numbers[lacking])))
        whole = pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), pa.array(sizes), pa.array(np.bincount(document, logs, len(sizes)), pa.float64()), lists], ["doc_id", "n_tokens", "log_likelihood", "rare"])
        for k in range(0, len(sizes), 1024):
            yield whole.slice(k, 1024)


def score(docs: DataFrame, vocab: Vocabulary, network: np.ndarray) -> DataFrame:
    return _scored(blocks(docs), vocab, network)


def _scored(cut_docs: DataFrame, vocab: Vocabulary, network: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (natural, summed over all tokens) and its mean a token."""
    context = cut_docs.sparkSession.sparkContext
    rows = cut_docs.select("words", "numbers", "sizes", "doc_ids").mapInArrow(partial(_score, vocab=context.broadcast(vocab), now=context.broadcast(network)), "doc_id long, n_tokens long, log_likelihood double, rare array<string>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))  # doc_ids may be null or repeat
    words = rows.select("row", F.explode("rare").alias("word")).join(vocab.counts, "word", "left")
    logs = words.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"))
    rows = rows.drop("rare").join(logs, "row", "left").select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return rows.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Trains on `docs` and scores every one of them."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut_docs = blocks(plain)
    vocab = _vocabulary(cut_docs)
    network = _trained(cut_docs, vocab, max(1, -(-vocab.size // SHARD_TOKENS)))
    return _scored(cut_docs, vocab, start() if network is None else network)


def op5_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
