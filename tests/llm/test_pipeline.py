"""The pipeline's stages, each on its own input, against plain Python."""

import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lanna.llm import language, tokens
from tests.llm.test_operators import SMALL, check_packing, plain_components, plain_secrets

STAGES = dict(corpus_pipeline.STAGES)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def kept(spark, name, docs):
    out = STAGES[name](spark, docs, SMALL)
    assert name == "packing" or out.columns == docs.columns
    return out.collect()


def test_stages(spark):
    docs = documents(spark)
    rows = docs.collect()
    assert {r["doc_id"] for r in kept(spark, "language", docs)} == {r["doc_id"] for r in rows if re.search(r"[^\W\d_]", r["text"])}
    alone = {d for d, _, c in plain_components([(r["doc_id"], r["text"]) for r in rows], corpus_pipeline.NEAR_PERCENT) if d == c}
    assert {r["doc_id"] for r in kept(spark, "near_dedup", docs)} == alone
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in kept(spark, "decontamination", docs)} == {r["doc_id"] for r in rows if not any(q in plain(r["text"]) for q in items)}
    masked = {r["doc_id"]: r for r in kept(spark, "secrets", docs)}
    assert len(masked) == len(rows) and all(("[SECRET]" in masked[r["doc_id"]]["text"]) >= bool(plain_secrets(r["text"])) and not plain_secrets(masked[r["doc_id"]]["text"]) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values()) and all(masked[r["doc_id"]]["text"] == r["text"] for r in rows if "[SECRET]" not in masked[r["doc_id"]]["text"])
    direct = Tokenizer.from_file(tokens.vocabulary_path(tokens.WORD_BPE))
    check_packing(kept(spark, "packing", docs), {r["doc_id"]: np.array(direct.encode(r["text"], add_special_tokens=False).ids + [1], "<u4") for r in rows})


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in documents(spark).collect()} and all(0 <= r["ids_crc32"] < 1 << 32 for r in rows)


def test_odd_rows_and_empty_tables(spark, odd_rows):
    for name, _ in corpus_pipeline.STAGES:
        kept(spark, name, odd_rows)
        assert kept(spark, name, odd_rows.limit(0)) == []
    left = kept(spark, "near_dedup", odd_rows)
    assert sum(r["doc_id"] == 1 for r in left) == 1 and sum(r["doc_id"] is None for r in left) == 1 and len(left) == 8


def test_rows_with_one_id_or_none_are_judged_each_for_itself(spark):
    long = [" ".join(f"{w}{k}" for k in range(30)) for w in "abcde"]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(1, long[0]), (1, long[1]), (1, long[1]), (2, long[0] + " more"), (None, long[2]), (None, long[3]), (None, long[2] + " x"), (None, item), (7, item), (7, long[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(t for _, t in STAGES["near_dedup"](spark, docs, SMALL).collect())
    same = lambda a, b: plain_components([(0, a), (1, b)], corpus_pipeline.NEAR_PERCENT)[1][2] == 0
    assert len(left) == len({t for t in left}) and not any(same(a, b) for a in left for b in left if a < b) and {long[1], rows[9][1]} <= set(left)
    assert len([t for t in left if t.startswith(long[0])]) == 1 and len([t for t in left if t.startswith(long[2])]) == 1
    clean = [tuple(r) for r in STAGES["decontamination"](spark, docs, SMALL).collect()]
    assert sorted(clean, key=str) == sorted([r for r in rows if r[1] != item], key=str)
