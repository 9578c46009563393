"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates are the base kinds (email, ip, card, phone: leftmost, non-overlapping,
without retries) and wider ones: `local` (phone numbers without a plus), `ssn`, `iban`
and `name` (a form of address and capitalised words).  Labelers look at a candidate
and vote for, against, or not: its strict form, gazetteers (top-level domains,
country codes, card issuers, given names, forms of address), the words before it,
and how its digits are spread.  Spark counts how often each kind meets each pattern
of votes, over all documents: a table of at most 8 * 3**5 rows.  From it EM
estimates per kind the share of personal data and each labeler's reliabilities, and
a logistic classifier of kind and votes is trained on EM's probabilities.  Base
spans are always reported; a wider one is if the classifier gives it 0.5 or more
and no other reported span touches it.

Defined results: null or empty text has no spans; null doc_ids stay null; repeated
rows give repeated results and count repeatedly; an empty table gives no rows.
Other columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.llm.common import Touched, bounded_batches, table, texts_of

BASE = ("email", "ip", "card", "phone")
WIDE = ("local", "ssn", "iban", "name")
KINDS = BASE + WIDE
LABELERS = ("form", "gazetteer", "context", "against", "digits")
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_NAME = re.compile(r"(?<![^\W_])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Name)[.:]?\x20((?:[A-ZÀ-Ý][a-zà-ÿ]+)(?:\x20[A-ZÀ-Ý][a-zà-ÿ]+){0,2})")

DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at se no fi dk pl be ie pt mx example test".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen peter anna paul laura hans klaus karl heinz ursula sabine jean marie pierre claire luc sophie juan maria jose carmen luis ana carlos lucia pedro elena".split())
_FOR = {
    "email": "email e-mail mail contact write address", "ip": "ip host server address login from client", "card": "card visa mastercard credit payment amex",
    "phone": "phone tel call mobile fax contact dial", "local": "phone tel call mobile fax contact dial", "ssn": "ssn social security", "iban": "iban account bank transfer", "name": "name contact signed from by dear",
}
_AGAINST = re.compile(r"\b(?:version|release|build|isbn|order|invoice|section|chapter|figure|table|page|serial|part|sku|doi|example)\b\W*(?:no\.?|number|#)?\W*$", re.IGNORECASE)
_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v.split())) + r")\b", re.IGNORECASE) for k, v in _FOR.items()}


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @, so that long runs of letters cost no more than their length."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        n = n * 2 - 9 * (n > 4) if k % 2 else n
        total += n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, sorted by start and then as listed."""
    found = [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


def wide_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if _DIGIT.search(text):
        for kind, pattern in (("local", _LOCAL_PHONE), ("ssn", _SSN), ("iban", _IBAN)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return found + [(m.start(1), m.end(1), "name") for m in _NAME.finditer(text)]


def _form(kind: str, s: str, digits: str) -> int:
    if kind == "email":
        return 1 if ".." not in s and s[0] != "." and ".@" not in s and s.rpartition(".")[2].isalpha() else -1
    if kind == "ip":
        return -1 if any(len(p) > 1 and p[0] == "0" for p in s.split(".")) or s.split(".")[0] == "0" else 1
    if kind == "card":
        return 1 if len(digits) in (15, 16) else -1
    if kind == "phone":
        return 1 if s.count("(") == s.count(")") and 10 <= len(digits) <= 13 else -1
    if kind == "local":
        return 1 if digits[0] in "23456789" and digits[3] in "23456789" else -1
    if kind == "ssn":
        return 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
    if kind == "iban":
        flat = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    return 1 if " " in s else 0


def _gazetteer(kind: str, s: str, digits: str) -> int:
    if kind == "email":
        return 1 if s.rpartition(".")[2].lower() in DOMAINS else 0
    if kind == "ip":
        return -1 if s.startswith(("127.", "0.", "255.")) else 0
    if kind == "card":
        return 1 if digits[0] in "3456" else -1
    if kind == "phone":
        return 1 if any(digits.startswith(c) for c in COUNTRY_CODES) else -1
    if kind == "name":
        return 1 if s.split()[0].lower() in GIVEN else 0
    return 0


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 none."""
    s, before = text[start:end], text[max(0, start - 48) : start]
    digits = digits_of(s)
    spread = 0 if not digits else -1 if len(set(digits)) <= 2 or digits in "01234567890123456789" else 1 if len(set(digits)) >= 5 else 0
    return _form(kind, s, digits), _gazetteer(kind, s, digits), int(bool(_CONTEXT[kind].search(before))), -int(bool(_AGAINST.search(before))), spread


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in texts_of(batch):
            for a, b, kind in base_spans(text) + wide_spans(text):
                seen[kind, *votes(text, a, b, kind)] += 1
    rows = list(seen.items())
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([list(k[1:]) for k, _ in rows], pa.list_(pa.int32())), pa.array([n for _, n in rows], pa.int64())], ["kind", "votes", "n"])


def reliabilities(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """EM for one kind: probabilities of the patterns, the share of personal data, and P(vote | class) by class, labeler and vote."""
    onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    truth = 1 / (1 + np.exp(-patterns.sum(axis=1) - 0.5))  # the votes' majority to begin with
    for _ in range(rounds):
        weight = np.stack([n * (1 - truth), n * truth])
        share = (weight[1].sum() + 2) / (n.sum() + 4)
        table_ = np.einsum("cp,plv->clv", weight, onehot) + np.array([[1.5, 1.0, 0.5], [0.5, 1.0, 1.5]])[:, None, :]  # labelers are better than chance
        table_ /= table_.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,clv->cp", onehot, np.log(table_)) + np.log([[1 - share], [share]])
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(now - truth).max() < 1e-9:
            break
        truth = now
    return truth, float(share), table_


def features(kinds: list[str], patterns: np.ndarray) -> np.ndarray:
    """One column a kind, and one for each vote for and against."""
    kind = np.array([[k == x for x in KINDS] for k in kinds], float).reshape(len(kinds), len(KINDS))
    return np.hstack([kind, (patterns > 0).astype(float), (patterns < 0).astype(float)])


def train(kinds: list[str], patterns: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of the span classifier: logistic regression (Newton's method) on EM's probabilities, each pattern weighed by its count."""
    soft = np.zeros(len(kinds))
    for kind in dict.fromkeys(kinds):
        own = np.array([k == kind for k in kinds])
        soft[own] = reliabilities(patterns[own], n[own])[0]
    x, w = features(kinds, patterns), np.zeros(len(KINDS) + 2 * len(LABELERS))
    scale = n / max(1, n.sum()) * 1000
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (soft - p)) - 0.1 * w
        hessian = x.T @ (x * (scale * p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def fit(docs: DataFrame) -> np.ndarray:
    """The span classifier, from the vote patterns of all candidates in `docs`."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "kind string, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()  # at most 8 * 3**5 rows
    return train([r["kind"] for r in rows], np.array([r["votes"] for r in rows], int).reshape(len(rows), len(LABELERS)), np.array([r["n"] for r in rows], float))


def all_spans(text: str, weights: np.ndarray) -> list[tuple[int, int, str]]:
    found = base_spans(text)
    wide = sorted(wide_spans(text))
    if wide:
        p = 1 / (1 + np.exp(-features([k for _, _, k in wide], np.array([votes(text, *x) for x in wide])) @ weights))
        touched, last = Touched(found), 0
        for (a, b, kind), sure in zip(wide, p):
            if sure >= THRESHOLD and a >= last and not touched(a, b):
                found.append((a, b, kind))
                last = b
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in all_spans(t, weights)] for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])


def find_personal(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id and its spans: kind, start, end, value; a row for each row of `docs`.  Without weights the classifier is fitted first."""
    weights = fit(docs) if weights is None else weights
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(partial(_scan, weights=weights), "doc_id long, spans array<struct<kind:string,start:int,end:int,value:string>>")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
