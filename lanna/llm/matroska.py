"""Matroska media columns: a muxer, and a parser of EBML elements into packet tables.

A text's bytes, padded with 255 to a positive multiple of 576, are stored as the
8-bit samples of one PCM track: frames of 576 samples, up to eight frames of equal
size laced in a block, a cluster for every 64 frames, cues for the clusters.  The
timestamp scale makes a tick one sample, so a frame lasts 576 ticks.  The parser knows
variable-length sizes (also of unknown length), void elements, SimpleBlocks and
BlockGroups, the four kinds of lacing, and cues.

Defined results: null text is empty, so 576 bytes of 255; null doc_ids stay null;
repeated rows give repeated results; an empty table gives no rows; a broken file
raises ValueError.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.llm.common import bounded_batches, slices, table, texts_of

FRAME = 576
LACED = 8
CLUSTER_FRAMES = 64
RATE = 8000
SCALE = 1_000_000_000 // RATE

EBML, SEGMENT, VOID = 0x1A45DFA3, 0x18538067, 0xEC
INFO, TIMESTAMP_SCALE, DURATION, APP = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80
TRACKS, TRACK, NUMBER, UID, KIND, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = frozenset({SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_TRACK_POSITIONS})
TOP = frozenset({INFO, TRACKS, CLUSTER, CUES})


def size_field(n: int) -> bytes:
    """The shortest variable-length size; all ones are kept for unknown sizes."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + size_field(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEADER = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_TRACKS = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(FREQUENCY, b"\x45\xfa\x00\x00") + number(CHANNELS, 1) + number(DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file with `payload`, whose length is a positive multiple of FRAME."""
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of a frame")
    head = element(INFO, number(TIMESTAMP_SCALE, SCALE) + element(APP, b"lanna")) + _TRACKS
    parts, cues, at = [head], [], len(head)
    for first in range(0, frames, CLUSTER_FRAMES):
        last, blocks = min(frames, first + CLUSTER_FRAMES), []
        for k in range(first, last, LACED):
            n = min(LACED, last - k)
            lacing = b"\x84" + bytes([n - 1]) if n > 1 else b"\x80"  # keyframe, fixed-size lacing
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + (FRAME * (k - first)).to_bytes(2, "big") + lacing + payload[FRAME * k : FRAME * (k + n)]))
        cluster = element(CLUSTER, number(TIMESTAMP, FRAME * first) + b"".join(blocks))
        cues.append(element(CUE, number(CUE_TIME, FRAME * first) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1 for a size of all ones."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the data end within the integer at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        n ^= 1 << (7 * width)
        n = -1 if n == (1 << (7 * width)) - 1 else n
    return n, at + width


@dataclass
class Media:
    """What a file holds.  Packets: (track, timestamp in ticks, start, stop, keyframe, cluster)."""

    scale: int = SCALE
    tracks: list[dict] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # place in the segment, timestamp
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, place of the cluster
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    lacings: set[int] = field(default_factory=set)
    elements: int = 0


def _laced(data: bytes, at: int, stop: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; kind: 1 Xiph, 2 fixed sizes, 3 EBML."""
    n = data[at] + 1
    at += 1
    if kind == 2:
        if (stop - at) % n:
            raise ValueError("frames of fixed-size lacing differ in size")
        sizes = [(stop - at) // n] * (n - 1)
    elif kind == 1:
        sizes = []
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        sizes = []
        for k in range(n - 1):
            before = at
            size, at = vint(data, at, False)
            sizes.append(sizes[-1] + size - ((1 << (7 * (at - before) - 1)) - 1) if k else size)
    ranges = []
    for size in sizes:
        ranges.append((at, at + size))
        at += size
    if at > stop or any(a > b for a, b in ranges):
        raise ValueError("laced frames go beyond their block")
    return [*ranges, (at, stop)]


def parse(data: bytes) -> Media:
    """What a file holds; byte ranges refer to `data`.  A file that is cut short or no Matroska file is a ValueError."""
    try:
        return _walked(data)
    except (IndexError, struct.error) as broken:
        raise ValueError("the file is cut short or broken") from broken


def _walked(data: bytes) -> Media:
    """Walks the elements of a file."""
    key, at = vint(data, 0, True)
    if key != EBML:
        raise ValueError("no EBML header")
    size, at = vint(data, at, False)
    out, segment, ticks, ends = Media(), 0, 0, [len(data)]
    at += size
    open_ids: list[int] = []
    while at < len(data) or len(ends) > 1:
        while len(ends) > 1 and at >= ends[-1]:
            ends.pop()
            open_ids.pop()
        if at >= len(data):
            break
        began = at
        key, at = vint(data, at, True)
        size, at = vint(data, at, False)
        if key in TOP and CLUSTER in open_ids:  # ends a cluster of unknown size
            k = open_ids.index(CLUSTER)
            del open_ids[k:], ends[k + 1 :]
        stop = ends[-1] if size < 0 else at + size
        if stop > ends[-1] or size < 0 and key not in (SEGMENT, CLUSTER):
            raise ValueError(f"the element at byte {began} goes beyond its parent")
        out.elements += 1
        if key in PARENTS:
            ends.append(stop)
            open_ids.append(key)
            if key == SEGMENT:
                segment = at
            elif key == TRACK:
                out.tracks.append({})
            elif key == CLUSTER:
                out.clusters.append((began - segment, 0))
            elif key == CUE:
                out.cues.append((0, 0, 0))
            continue
        if key in (SIMPLE_BLOCK, BLOCK):
            track, body = vint(data, at, False)
            when = ticks + int.from_bytes(data[body : body + 2], "big", signed=True)
            flags = data[body + 2]
            kind = flags >> 1 & 3
            out.lacings.add(kind)
            ranges = _laced(data, body + 3, stop, kind) if kind else [(body + 3, stop)]
            rate = next((t.get("rate", RATE) for t in out.tracks if t.get("number") == track), RATE)
            step = lambda a, b: round((b - a) * 1_000_000_000 / (rate * out.scale))  # noqa: E731  one byte a sample
            for a, b in ranges:
                out.packets.append((track, when, a, b, bool(flags & 128) or key == BLOCK, len(out.clusters) - 1))
                when += step(a, b)
        else:
            body = data[at:stop]
            n = int.from_bytes(body, "big")
            if key == TIMESTAMP_SCALE:
                out.scale = n
            elif key == TIMESTAMP:
                ticks = n
                out.clusters[-1] = (out.clusters[-1][0], n)
            elif key == NUMBER:
                out.tracks[-1]["number"] = n
            elif key == CODEC:
                out.tracks[-1]["codec"] = body.decode()
            elif key == FREQUENCY:
                out.tracks[-1]["rate"] = struct.unpack(">f" if len(body) == 4 else ">d", body)[0]
            elif key == CUE_TIME:
                out.cues[-1] = (n, *out.cues[-1][1:])
            elif key == CUE_TRACK:
                out.cues[-1] = (out.cues[-1][0], n, out.cues[-1][2])
            elif key == CUE_CLUSTER:
                out.cues[-1] = (*out.cues[-1][:2], n)
        at = stop
    return out


def payload_of(data: bytes, media: Media) -> bytes:
    return b"".join(data[a:b] for _, _, a, b, _, _ in media.packets)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


MEDIA = "doc_id long, n_bytes long, media binary"
PACKETS = "media_id long, packet long, track int, timestamp long, start long, stop long, keyframe boolean, cluster int"


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch)
        for a, b in slices(batch, [*map(len, texts)]):
            both = [padded(x) for x in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array([n for _, n in both], pa.int64()), pa.array([mux(x) for x, _ in both], pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, and the Matroska file that holds it."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_mux, MEDIA)


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PACKETS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
    for batch in batches:
        for doc, data in zip(batch.column("media_id").to_pylist(), batch.column("media")):
            if data.is_valid:
                rows = [(doc, k, t, when, a, b, key, c) for k, (t, when, a, b, key, c) in enumerate(parse(data.as_py()).packets)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 8, kinds)], names)


def packet_table(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """A row a packet of the Matroska files in column `media`: track, timestamp in ticks, byte range, keyframe, cluster; null files give none."""
    bounded_batches(files.sparkSession)
    return files.select(F.col(key).cast("long").alias("media_id"), F.col(media).cast("binary").alias("media")).mapInArrow(_packets, PACKETS)


def feature(data: bytes, media: Media, payload: bytes) -> str:
    """Counts of what the parser found, whether cues point at clusters, the length in ticks, and the samples' mean and mean absolute step."""
    import numpy as np

    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    places = dict(media.clusters)
    good = sum(places.get(at) == when for when, _, at in media.cues)
    end = max((when + b - a for _, when, a, b, _, _ in media.packets), default=0)
    step = int(np.abs(np.diff(samples)).sum())
    return f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={good}/{len(media.cues)};packets={len(media.packets)};ticks={end};lacing={','.join(map(str, sorted(media.lacings)))};sum={int(samples.sum())};step={step}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
            data = data.as_py()
            media = parse(data)
            payload = payload_of(data, media)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, media, payload)))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 8, kinds)], names)


def op4_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents")).mapInArrow(_digest, DIGEST)
