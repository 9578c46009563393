"""Secret scans: base patterns, and dictionary-primed zstandard novelty in sensitive context.

Base kinds, leftmost and non-overlapping each: `assign` (a keyword, a sign and a
value of 8 or more characters), `access` (AKIA and capitals or digits, 16 or more
characters), `hex` (32 or more lower-case hexadecimal digits).  The method adds
`novel`: strings of 16 or more token characters with a digit and a letter, within
CONTEXT characters after a sensitive word, that don't compress.  Of a string what is
no dictionary identifier is measured, as an identifier's match costs some bytes too;
it must have REST characters or more, whose marginal compressed bytes, given the
dictionary and the text on both sides, are at least NOVELTY of their number.  A string
that a base span touches is not reported again.  Time is linear in the text's length.

Defined results: null or empty text has no spans; null doc_ids stay null; repeated
rows give repeated results; an empty table gives no rows.  Other columns are
ignored, but `redacted` hands them on.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.llm.common import Touched, bounded_batches, table, texts_of

KINDS = ("assign", "access", "hex", "novel")
CONTEXT = 64
SURROUNDING = 384
NOVELTY = 0.66
REST = 12

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "private_key", "private-key", "access_key", "authorization")
_SENSITIVE = re.compile("|".join(_WORDS), re.ASCII | re.IGNORECASE)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")

#: What code around secrets is made of: repeating it costs few bytes, so names and paths aren't novel.
IDENTIFIERS = " ".join(
    """abstract access account action admin agent alias allow amount android answer append application argument array assert async attribute authorization
    await backend balance bearer binary block body boolean bucket buffer build bundle button bytes cache callback catch certificate channel char class client
    cloud cluster code collection column command comment commit common compare component compress config connect connection console const container content
    context cookie copy count create credential current cursor custom customer data database date debug default define delete deploy description development
    device dictionary digest directory disable document domain double download driver element email empty enable encode encrypt endpoint engine environment
    error event example exception execute exit expire export false feature field file filter final float folder format forward frame function gateway generate
    github global group handler hash header height hidden host html http https identifier image implement import include index info init input insert instance
    integer interface internal invalid item iterator javascript json key kubernetes label language layer length level library license limit line link list load
    local location logger login main manager mapping master match maximum memory merge message metadata method middleware migration minimum mobile model module
    monitor name namespace network node notification null number object offset operation option order output package page parameter parent parse partition
    password path pattern payload payment permission persist pipeline platform plugin pointer policy pool port position postgres prefix private process producer
    production profile project property protected protocol provider proxy public publish python query queue random range read record redirect redis reference
    region register release remote remove render replace report repository request require reset resource response result return role root route sample scale
    schema scope script search secret section secure select sender sequence server service session setting signature simple size socket source stack staging
    standard start state static status storage stream string struct style submit success suffix switch symbol sync system table target task template tenant test
    text thread timeout timestamp title token tool transaction transfer transform trigger true type undefined unique update upload user username uuid validate
    value variable vector vendor version view virtual visible warning webhook width window worker workspace write xml yaml zone your_token_here changeme
    placeholder xxxxxxxxxxxxxxxx 00000000000000000000 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ""".split()
).encode()


_PARTS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
_NAMES = frozenset(w for w in IDENTIFIERS.decode().lower().split() if len(w) > 2)


@lru_cache(1)
def _compressor() -> zstandard.ZstdCompressor:
    prime = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bytes(text: str, start: int, end: int, value: str | None = None) -> int:
    """Compressed bytes that text[start:end], or `value` in its place, adds to the text on both sides of it, where the string itself doesn't count if it comes again."""
    whole = text[start:end]
    value = whole if value is None else value
    around = (text[max(0, start - SURROUNDING) : start] + "\n" + text[end : end + SURROUNDING] + "\n").replace(whole, "").encode("utf-8", "surrogatepass")
    pack = _compressor()
    return len(pack.compress(around + value.encode("utf-8", "surrogatepass"))) - len(pack.compress(around))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, sorted by start and then as listed."""
    low, found = text.lower(), []
    if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def rest_of(value: str) -> str:
    """A string without the dictionary identifiers in it and the signs between them."""
    return _PARTS.sub(lambda m: "" if m.group().lower() in _NAMES else m.group(), value).strip("_-/+=")


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Incompressible strings after sensitive words."""
    low = text.lower()
    if not any(k in low for k in _WORDS):
        return []
    ends, at = [m.end() for m in _SENSITIVE.finditer(text)], 0
    found, touched = [], Touched(base)
    for m in _CANDIDATE.finditer(text):
        while at < len(ends) and ends[at] <= m.start():
            at += 1
        if not at or m.start() > ends[at - 1] + CONTEXT:
            continue
        value = m.group()
        if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) or touched(m.start(), m.end()):
            continue
        rest = rest_of(value)
        if len(rest) >= REST and marginal_bytes(text, m.start(), m.end(), rest) >= novelty * len(rest):
            found.append((m.start(), m.end(), "novel"))
    return found


def all_spans(text: str, novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty), key=lambda x: (x[0], KINDS.index(x[2])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch], novelty: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in all_spans(t, novelty)] for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """doc_id and its spans: kind, start, end, value; a row for each row of `docs`."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(partial(_scan, novelty=novelty), "doc_id long, spans array<struct<kind:string,start:int,end:int,value:string>>")


def mask(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """`text` with `mark` for each run of overlapping spans."""
    out, at, open_end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= open_end:
            out += [text[at:a], mark]
        open_end = at = max(open_end, b)
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch], column: int, novelty: float, mark: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column(column)
        texts = [t if not t or not (s := all_spans(t, novelty)) else mask(t, s, mark) for t in own.to_pylist()]
        yield batch.set_column(column, batch.schema.field(column), pa.array(texts, own.type))


def redacted(docs: DataFrame, novelty: float = NOVELTY, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in `text` replaced by `mark`; all other columns and rows stay as they are."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_mask, column=docs.columns.index("text"), novelty=novelty, mark=mark), docs.schema)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
