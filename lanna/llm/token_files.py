"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a run of blocks, each ended by the byte 10.  The first block is the
table of ids by falling corpus frequency; the others hold documents in ascending
doc_id order:

    table  "LFRT" | u32 n                                   | u32 id of rank 0 .. n-1
    block  "LFRB" | u32 documents, u64 ids, u32 control bytes, u32 data bytes, u32 bits
                  | i64 doc_id * documents | u32 count * documents | control | data

Every id is written as its rank in 1 .. 2**bits bytes, low byte first.  The
control stream has `bits` bits an id (1 while all ranks are below 65,536, else
2), low bits first, which hold the number of bytes less one.  numpy decodes by
looking the control bytes up in a table of lengths.

Defined results: null or empty text is a document of the end id alone; a null
doc_id is stored as the largest 64-bit integer and sorts last; repeated rows are
repeated documents; rows with one doc_id stay in one file, in any order; an
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanna.llm.common import BATCH_BYTES, bounded_batches, forget, shared_dir, slices, table, texts_of, written
from lanna.llm.tokens import BYTE_BPE, encoder, vocabulary_path

END_ID = 2
BLOCK_IDS = 1 << 19
FILE_IDS = 12 << 20
LAST_ID = (1 << 63) - 1
_TABLE, _BLOCK = b"LFRT", b"LFRB"
_HEAD = struct.Struct("<4sIQIII")


def _lengths(bits: int) -> np.ndarray:
    per = 8 // bits
    return ((np.arange(256)[:, None] >> (bits * np.arange(per))) & ((1 << bits) - 1)).astype(np.uint8) + 1


_LENGTHS = {bits: _lengths(bits) for bits in (1, 2)}


def encode_ranks(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    ranks = ranks.astype(np.uint32)
    size = np.ones(len(ranks), np.uint8)
    for k in range(1, 1 << bits):
        size += ranks >= (1 << (8 * k))
    per = 8 // bits
    padded = np.zeros(-(-len(ranks) // per) * per, np.uint8)
    padded[: len(ranks)] = size - 1
    control = np.bitwise_or.reduce(padded.reshape(-1, per) << (bits * np.arange(per, dtype=np.uint8)), axis=1).astype(np.uint8)
    raw = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int, bits: int) -> np.ndarray:
    """Ranks from control and data bytes: a table lookup gives the lengths, their sums the places."""
    size = _LENGTHS[bits][np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in range(1, 1 << bits):
        wide = np.flatnonzero(size > k)
        ranks[wide] |= raw[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _ids(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n, ids: the ids of each text as compressed little-endian integers; at last a row with n = -1 and the counts of all ids."""
    enc, pack = encoder(path, True), zstandard.ZstdCompressor(1)
    kind, seen = np.uint16 if max(enc.size, end + 1) <= 1 << 16 else np.uint32, np.zeros(0, np.int64)
    for batch in batches:
        texts = texts_of(batch)
        for a, b in slices(batch, [*map(len, texts)], BATCH_BYTES):
            flat, sizes = enc.encode(texts[a:b], end)
            flat, ends = flat.astype(kind), np.cumsum(sizes)
            ids = [pack.compress(flat[e - n : e].tobytes()) for e, n in zip(ends, sizes)]
            now = np.bincount(flat)
            if len(now) > len(seen):
                now, seen = seen, now
            seen[: len(now)] += now
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(sizes), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], ["doc_id", "n", "ids"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    sizes = batch.column("n").to_numpy()
    unpack = zstandard.ZstdDecompressor()
    raw = [unpack.decompress(x) for x in batch.column("ids").to_pylist()]
    wide = bool(raw) and len(raw[0]) > 2 * sizes[0]
    return sizes, np.frombuffer(b"".join(raw), np.uint32 if wide else np.uint16)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            seen = np.frombuffer(raw, "<i8")
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["id", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], by_rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of one file; documents come in doc_id order."""
    rank = np.zeros(int(by_rank.max()) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    bits = 1 if len(by_rank) <= 1 << 16 else 2
    as_row = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["value"])
    begun, docs, sizes, ids, n = False, [], [], [], 0

    def block() -> pa.RecordBatch:
        control, data = encode_ranks(np.concatenate(ids), bits)
        head = _HEAD.pack(_BLOCK, len(docs), n, len(control), len(data), bits)
        return as_row(head + np.asarray(docs, "<i8").tobytes() + np.asarray(sizes, "<u4").tobytes() + control + data)

    for batch in batches:
        if not batch.num_rows:
            continue
        if not begun:
            begun = True
            yield as_row(_TABLE + struct.pack("<I", len(by_rank)) + by_rank.astype("<u4").tobytes())
        own, flat = _unpacked(batch)
        ends = np.cumsum(own)
        for doc, size, end in zip(batch.column("doc_id").to_pylist(), own.tolist(), ends.tolist()):
            docs.append(doc)
            sizes.append(size)
            ids.append(rank[flat[end - size : end]])
            n += size
            if n >= BLOCK_IDS:
                yield block()
                docs, sizes, ids, n = [], [], [], 0
    if docs:
        yield block()


def decode_file(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, counts and ids of each block of a file."""
    by_rank, at = np.zeros(0, np.uint32), 0
    while at < len(content):
        if content[at : at + 4] == _TABLE:
            (n,) = struct.unpack_from("<I", content, at + 4)
            by_rank = np.frombuffer(content, "<u4", n, at + 8)
            at += 8 + 4 * n
        else:
            kind, docs, n, n_control, n_data, bits = _HEAD.unpack_from(content, at)
            if kind != _BLOCK:
                raise ValueError(f"no block begins at byte {at}")
            at += _HEAD.size
            doc_ids, sizes = np.frombuffer(content, "<i8", docs, at), np.frombuffer(content, "<u4", docs, at + 8 * docs)
            at += 12 * docs
            ranks = decode_ranks(content[at : at + n_control], content[at + n_control : at + n_control + n_data], n, bits)
            at += n_control + n_data
            yield doc_ids, sizes, by_rank[ranks]
        if content[at : at + 1] != b"\n":
            raise ValueError(f"the block before byte {at} is not ended")
        at += 1


def _read(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """A row a document: its file, place there, count and ids or their crc32."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            first, before, order = None, 0, 0
            for docs, sizes, ids in decode_file(content.as_py()):
                first = int(docs[0]) if first is None else first
                raw, ends = ids.astype("<u4"), np.cumsum(sizes, dtype=np.int64)
                own = [raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = {
                    "doc_id": pa.array(docs, pa.int64()), "path": pa.array([path] * len(docs), pa.string()), "first_doc": pa.array([first] * len(docs), pa.int64()),
                    "at": pa.array(before + ends - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
                    "ids": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])
                before += int(ends[-1])


def write_token_files(docs: DataFrame, to: str, vocabulary: str = BYTE_BPE, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of all texts of `docs` to folder `to`, files and documents in ascending doc_id order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = written(plain.mapInArrow(partial(_ids, path=vocabulary_path(vocabulary), end=end_id), "doc_id long, n long, ids binary"), "none")
    counts = ids.where("n < 0").select("ids").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row an id of the vocabulary at most
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    by_rank, total = counts["id"].to_numpy(np.uint32), int(counts["n"].sum()) if len(counts) else 0
    if not total:
        by_rank = np.zeros(1, np.uint32)
    files = max(1, -(-total // file_ids))
    # The text source writes a value's bytes as they are and a line feed; Spark's commit protocol keeps files of failed attempts out.
    ordered = ids.where("n >= 0").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(partial(_blocks, by_rank=by_rank), "value binary").select(F.col("value").cast("string")).write.text(to)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids, or with `digest` their crc32, from the files in `path`."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    kind = "ids long" if digest else "ids array<long>"
    rows = files.mapInArrow(partial(_read, digest=digest), f"doc_id long, path string, first_doc long, at long, n_tokens long, {kind}")
    if digest:
        rows = written(rows)
    sums = rows.groupBy("path").agg(F.min("first_doc").alias("first_doc"), F.sum("n_tokens").alias("total"))  # a row a file
    before = F.sum("total").over(Window.orderBy("first_doc", "path").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(starts, "path").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), to)
    forget(spark, to)
    return read_token_files(spark, to, digest=True).withColumnRenamed("ids", "ids_crc32")
