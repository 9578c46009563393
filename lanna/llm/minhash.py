"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct five-word shingles (ASCII lower case; a shorter text
is one shingle).  Two permutations make all signature coordinates: the first maps
shingles to 32-bit values, the second, circularly shifted by k steps, ranks them for
coordinate k, which is the smallest rank.  Documents that agree in the coordinates of
one band share a bucket.  The rows of a band follow from the threshold: as many, 5 at
most, as leave a pair at the threshold without a common band with a probability below
1e-6; at 0.85 5 rows in 28 bands (1e-7), at 0.8 4 rows in 35 bands (1e-8).

Equal sets are one class, represented by its smallest doc_id.  In every bucket the
classes are compared with a leader first, and links are merged into components;
then, in buckets that still hold several components, all pairs of different
components are compared: small buckets directly, large ones in blocks of BLOCK by
BLOCK classes, so no bucket is gathered in a task and no pair is left out; a block
gives its links, not its pairs, and a pair is compared in its first common band.  Pairs
whose signatures agree too rarely or whose sizes differ too much are not linked (a
linked pair agrees in fewer than `least` of 140 coordinates with a probability
below 1e-7); all others are decided on their full sets, 100 * intersection >=
percent * union.  Components grow by alternating large and small stars, in tables.

Defined results: a text without words, or null, has an empty set and is linked with
nothing; a row with a null doc_id has a null component_id and is kept; repeated rows
get the same component; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.llm.common import bounded_batches, slices, table, take_turn, written
from lanna.llm.substrings import mixed, rolling

SHINGLE = 5
COORDINATES = 140
PERCENT = 85
SMALL, BLOCK = 16, 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = (np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B1)).astype(np.uint32)[:, None]
_WORDS_KEPT = 200_000


class Threshold:
    """The least similarity in percent, and the bands and the signature bound for it."""

    def __init__(self, percent: int = PERCENT):
        self.percent, p = percent, percent / 100
        self.rows = next((r for r in (5, 4, 2) if (1 - p**r) ** (COORDINATES // r) < 1e-6), 1)
        self.bands = COORDINATES // self.rows
        #: A linked pair agrees in COORDINATES * p coordinates on average; this is 6 standard deviations less.
        self.least = max(0, int(COORDINATES * p - 6 * (COORDINATES * p * (1 - p)) ** 0.5))
        self.band = mixed(np.arange(1, self.bands + 1, dtype=np.uint64))
        self.weights = mixed(np.arange(101, 101 + self.rows, dtype=np.uint64)) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    take_turn("minhash", _hashes.clear)
    if len(_hashes) > _WORDS_KEPT:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return mixed(rolling(h, len(h), _BASE) + np.uint64(len(h)))
    return np.unique(mixed(rolling(h, SHINGLE, _BASE)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES smallest ranks; the first permutation is the hash's own, the second is a bijective mix that the shifts turn."""
    first = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 2048):
        x = first[None, at : at + 2048] + _SHIFTS
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x85EBCA6B)
        np.right_shift(x, np.uint32(13), out=t)
        x ^= t
        x *= np.uint32(0xC2B2AE35)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, at: Threshold = Threshold()) -> np.ndarray:
    return mixed((sig.reshape(at.bands, at.rows).astype(np.uint64) * at.weights).sum(axis=1, dtype=np.uint64) ^ at.band)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(batches: Iterator[pa.RecordBatch], at: Threshold) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(batch, [len(t or "") for t in texts]):
            sizes, prints, bands, sigs = [], [], [], []
            for t in texts[a:b]:
                s = shingle_set(t)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig = signature(s) if len(s) else None
                bands.append(None if sig is None else band_keys(sig, at).view(np.int64))
                sigs.append(None if sig is None else (sig & np.uint32(255)).astype(np.uint8).tobytes())
            columns = [batch.column("doc_id")[a:b], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print", "bands", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(batch, [len(t or "") for t in texts]):
            yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], pa.array([shingle_set(t).tobytes() for t in texts[a:b]], pa.binary())], ["id", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch], at: Threshold) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
        good = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), at.percent) for x, y in sets], pa.bool_())
        yield batch.select(["a", "b"]).filter(good)


def _likely(batches: Iterator[pa.RecordBatch], at: Threshold) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures and sizes allow a link."""
    for batch in batches:
        if batch.num_rows:
            sig = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in ("sig_a", "sig_b")]
            sizes = np.stack([batch.column(k).to_numpy() for k in ("size_a", "size_b")])
            good = ((sig[0] == sig[1]).sum(axis=1) >= at.least) & (100 * sizes.min(axis=0) >= at.percent * sizes.max(axis=0))
            yield batch.select(["a", "b"]).filter(pa.array(good))


def _block_pairs(rows, at: Threshold):
    """Of a group of rows, one block of a bucket or two: for each row the later rows that it may be linked with, which no earlier band compares."""
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, COORDINATES)
    bands = np.array(rows["bands"].tolist(), np.int64).reshape(-1, at.bands)
    label, size, block = (rows[k].to_numpy() for k in ("label", "size", "block"))
    first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    earlier = int(np.flatnonzero(bands[0] == rows["key"].iloc[0])[0])
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    for k in left:
        other = right[right > k] if first == second else right
        other = other[(label[other] != label[k]) & (100 * np.minimum(size[other], size[k]) >= at.percent * np.maximum(size[other], size[k]))]
        other = other[(sig[other] == sig[k]).sum(axis=1) >= at.least]
        other = other[~(bands[other, :earlier] == bands[k, :earlier]).any(axis=1)]
        if len(other):
            yield k, other


def _active(rows, at: Threshold):
    """The rows of a group that have any such pair."""
    keep = np.zeros(len(rows), bool)
    for k, other in _block_pairs(rows, at):
        keep[k] = keep[other] = True
    return rows[keep]


def _links(rows, at: Threshold):
    """The links in a group, but those that others imply."""
    import pandas as pd

    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    ids, found = rows["class_id"].to_numpy(), []
    root = {x: x for x in rows["label"].tolist()}
    label = rows["label"].tolist()

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, other in _block_pairs(rows, at):
        own, sizes = sets[k], np.array([len(sets[o]) for o in other])
        flat = np.concatenate([sets[o] for o in other])
        equal = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(equal, np.cumsum(sizes) - sizes, dtype=np.int64)
        for o in other[100 * both >= at.percent * (len(own) + sizes - both)].tolist():
            x, y = top(label[k]), top(label[o])
            if x != y:
                root[x] = y
                found.append((min(ids[k], ids[o]), max(ids[k], ids[o])))
    return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of all ids in `edges` (a, b): large and small stars in turn until nothing changes."""
    state = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = state.union(state.select("b", "a"))  # large star: larger neighbours go to the smallest one
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        state = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = state.groupBy("b").agg(F.min("a").alias("m"))  # small star: an id and its smaller neighbours go to the smallest one
        near = state.join(least, "b")
        state = written(near.select(F.col("m").alias("a"), "b").union(near.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return state.select(F.col("b").alias("id"), F.col("a").alias("component")).union(state.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """At a similarity of at least `percent`: doc_id, n_shingles, component_id (the smallest doc_id of its component), kept; a row for each row of `docs`."""
    spark, at = docs.sparkSession, Threshold(percent)
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(partial(_signatures, at=at), "doc_id long, n_shingles long, print binary, bands array<long>, sig binary"))
    real = signed.where("doc_id is not null and print is not null")
    classes = real.groupBy("print").agg(F.min("doc_id").alias("class_id"))
    # Rows with one doc_id and several texts: the smallest print stands for the id.
    firsts = classes.groupBy("class_id").agg(F.min("print").alias("print"))
    own = real.join(firsts, "print").where("doc_id = class_id").dropDuplicates(["print"])
    own = written(own.select("class_id", F.col("n_shingles").alias("size"), "sig", "bands"))
    signs = own.select("class_id", "size", "sig")

    rows = own.select("class_id", F.explode("bands").alias("key"))
    leaders = rows.groupBy("key").agg(F.min("class_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = written(rows.join(leaders, "key"))

    others = members.where("key % 4 = 0").groupBy("key").agg(F.min(F.struct(F.xxhash64("class_id", "key"), "class_id"))["class_id"].alias("other"))
    # The ids grow with the corpus, so they are never broadcast.
    ids = members.select(F.col("class_id").alias("id")).distinct().hint("merge")
    sets = written(docs.withColumnRenamed("doc_id", "id").join(ids, "id").mapInArrow(_sets, "id long, shingles binary").dropDuplicates(["id"]), "none")

    def side(name: str) -> DataFrame:
        return signs.select(F.col("class_id").alias(name), F.col("size").alias(f"size_{name}"), F.col("sig").alias(f"sig_{name}"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b): those that are linked."""
        likely = pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(partial(_likely, at=at), "a long, b long")
        whole = likely.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
        return whole.mapInArrow(partial(_verify, at=at), "a long, b long")

    def pair(x: str, y: str):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    stars = members.where("class_id <> leader").select(*pair("class_id", "leader")).union(members.join(others, "key").where("class_id <> other").select(*pair("class_id", "other")))
    edges = written(verified(stars))
    found = components(edges)

    labelled = members.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("key", "class_id", "n", F.coalesce("component", "class_id").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    labelled = written(labelled.join(open_keys, "key"))
    few = labelled.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("class_id", "label"))).alias("of"))
    few = few.select(F.explode("of").alias("x"), "of").select("x", F.explode(F.filter("of", lambda y: (y["class_id"] > F.col("x.class_id")) & (y["label"] != F.col("x.label")))).alias("y"))
    few = few.select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = labelled.where(F.col("n") > SMALL).withColumn("block", F.pmod(F.xxhash64("class_id"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    group = "key long, i int, j int, block int, class_id long, label long"
    many = many.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "class_id", "label")
    active = many.join(own, "class_id").select("key", "i", "j", "block", "class_id", "label", "size", "sig", "bands").groupBy("key", "i", "j").applyInPandas(lambda rows: _active(rows, at), f"{group}, size long, sig binary, bands array<long>")
    active = active.join(sets.withColumnRenamed("id", "class_id"), "class_id")
    edges = edges.union(verified(few)).union(active.groupBy("key", "i", "j").applyInPandas(lambda rows: _links(rows, at), "a long, b long"))
    found = components(edges)

    ids = classes.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("print", F.coalesce("component", "class_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "print").join(ids, "print", "left")
    component = F.when(F.col("print").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
