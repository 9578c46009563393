"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanna.llm import decontamination, language, matroska, minhash, packing, pii, pseudo_likelihood, queries, secrets, substrings, token_files, tokens

SMALL = "/root/testdata/sf0.001"
NEEDED = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(spark):
    return {r["doc_id"]: r["text"] for r in documents(spark).collect()}


@lru_cache
def direct(name):
    return Tokenizer.from_file(tokens.vocabulary_path(name))


def encoded(name, text, end):
    return np.array(direct(name).encode(text, add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name,spaces", [(tokens.BYTE_BPE, True), (tokens.WORD_BPE, False)])
def test_cached_encoding_is_exact(name, spaces):
    rng = random.Random(3)
    alphabet = "ab,.'sS12é中́ \n\t\xa0 \x1cßİΣς😀-ñ²"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + ["", " ", "\n\n a", "it's  we'll  \n"]
    enc = tokens.UnitEncoder(tokens.vocabulary_path(name), spaces, limit=500)
    direct = Tokenizer.from_file(tokens.vocabulary_path(name))
    direct.encode_special_tokens = True
    for k in range(0, len(odd), 400):
        flat, sizes = enc.encode(odd[k : k + 400], 7)
        at = 0
        for text, n in zip(odd[k : k + 400], sizes):
            assert flat[at : at + n].tolist() == direct.encode(text, add_special_tokens=False).ids + [7]
            at += n


# -- 1 -----------------------------------------------------------------------


def test_decontamination(spark, odd_rows):
    docs = spark.createDataFrame(
        [
            (1, "Known. A train travels 120 km in 3 hours from Lyon to Paris. What is the average speed of the train in km per hour then?"),
            (2, "A train travels 120 km in 3 hours from Lyon to Paris. What is the average pace of the boat? A clean text."), (3, "nothing of that kind here at all"), (4, None), (5, ""), (6, "so what is two plus two today"),
            (7, "A train travels 80 km in 4 hours from Bonn to Kiel. What is the average speed of the train in km per hour then? And more."),
        ], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "A train travels 80 km in 4 hours from Bonn to Kiel. What is the average speed of the train in km per hour then?"), (11, "two plus two"), (12, None), (13, "")], "item_id long, text string")
    for most in (1 << 20, 0):
        found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.contaminated(docs, bench, filter_most=most).collect()}
        assert found == {(1, 10): False, (7, 10): True, (6, 11): True}
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0 == decontamination.contaminated(docs, bench.limit(0)).count()
    assert decontamination.contaminated(odd_rows, bench).count() == 0


def test_slots_must_be_consistent(spark):
    item = "If 5 apples cost 7 coins then how many coins would 5 more such apples cost the buyer in total today"
    twisted = item.replace("5 apples", "6 apples", 1)  # one value of the item has two in the text
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("5", "9").replace("7", "8")), (2, twisted)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(docs, bench).collect()] == [1]


def test_names_that_begin_sentences(spark):
    item = "Alice has 5 apples. Bob gives her 3 more apples than before. Alice then eats 2 of all the apples she has."
    other = "Maria has 9 apples. Tom gives her 4 more apples than before. Maria then eats 6 of all the apples she has."
    mixed = other.replace("Maria then", "Tom then")
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So: " + other), (2, mixed), (3, item)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contaminated(docs, bench).collect()}
    assert {1, 3} <= set(got) and got[3]["exact"] and not got[1]["exact"] and got[1]["coverage"] > 0.9 and (2 not in got or got[2]["coverage"] < got[1]["coverage"])


def plain_templates(t, names=True):
    """Template tokens of a text and what stands in each."""
    out, raw = [], (t or "").split()
    first, kinds = True, []
    for w in raw:
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", w)
        number = bool(re.fullmatch(r"[$€£+-]?[0-9][0-9.,:/]*(?:%|[A-Za-zµ°]{1,3})?", w.strip(".,;:!?()[]\"'")) or bare.isdigit())
        capital = bare[:1].isupper() and not bare[1:].isupper()
        kind = "" if not bare else "num" if number else "unit" if bare.lower() in decontamination.UNITS and kinds and kinds[-1] == "num" and not first else "name" if capital and names else "word"
        if kind == "name" and kinds and kinds[-1] == "name" and not first:
            out[-1] = ("name", out[-1][1] + " " + bare.lower())
        elif kind:
            out.append((kind, bare.lower()))
        kinds.append(kind)
        first = w.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":", "|")
    return out


def plain_template_matches(docs, items):
    w, found = decontamination.WINDOW, {}

    def windows(t, names=True):
        own = plain_templates(t, names)
        for k in range(len(own) - w + 1):
            part = own[k : k + w]
            if sum(x == "word" for x, _ in part) >= decontamination.LITERAL:
                yield k, tuple(v if x == "word" else "<" + x for x, v in part), [v for x, v in part if x != "word"]

    for i, q in items:
        for theirs in ([*windows(q)], [*windows(q, False)]):
            for d, t in docs:
                lines = {}
                for k, form, slots in windows(t):
                    for at, other, values in theirs:
                        if form == other:
                            places, pairs = lines.setdefault(k - at, (set(), set()))
                            places.add(at)
                            pairs.update(zip(values, slots))
                good = [places for places, pairs in lines.values() if len({a for a, _ in pairs}) == len(pairs)]
                n = len(set().union(*good)) if good else 0
                if theirs and n / len(theirs) >= decontamination.COVERAGE:
                    found[d, i] = max(found.get((d, i), (0, 0)), (round(n / len(theirs), 6), n))
    return found


def test_templates_by_brute_force(spark):
    rng = random.Random(12)
    names, nouns, units = ["Alice", "Bob", "Carol Jones", "Lyon", "Kiel"], ["apples", "coins", "boxes"], ["km", "hours", "kg"]

    def question(form):
        pick = lambda x: rng.choice(x)
        return form.format(a=pick(names), b=pick(names), n=rng.randint(2, 99), m=rng.randint(2, 99), x=pick(nouns), u=pick(units))

    forms = [
        "{a} has {n} {x} and gives {m} of them to {b}. How many of the {x} are left with {a} at the end?", "A train goes {n} {u} from {a} to {b} and then {m} {u} back again, how far did the old train go?",
        "In the shop {n} {x} cost {m} coins, so what would {n} more such {x} cost to {b} in total?",
    ]
    items = [(k, question(rng.choice(forms))) for k in range(12)]
    docs = [(k, rng.choice(["", "Well. ", "so it is said that "]) + question(rng.choice(forms)) + rng.choice(["", " And more text follows here.", " " + question(rng.choice(forms))])) for k in range(60)]
    docs += [(100 + k, q.lower() if k % 2 else q.upper()) for k, q in items]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_windows"]) for r in got} == plain_template_matches(docs, items)
    assert {(100 + k, k) for k, _ in items} <= {(r["doc_id"], r["item_id"]) for r in got}


def test_decontamination_of_rows_without_ids(spark):
    item = "A train travels 80 km in 4 hours from Bonn to Kiel. What is the average speed of the train in km per hour then?"
    words = item.split()
    docs = spark.createDataFrame([(None, item), (None, "a clean text"), (None, " ".join(words[:9])), (None, " ".join(words[9:])), (5, item), (5, "another clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in decontamination.contaminated(docs, bench).collect()) in ([0, 5], [0, 0, 5])
    left = [r["text"] for r in decontamination.clean(docs, bench).collect()]
    assert "a clean text" in left and "another clean text" in left and item not in left and " ".join(words[:9]) in left


def test_leaks_in_the_sample(spark):
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    expected = {(d, i) for d, t in texts(spark).items() for i, q in items if q in plain(t)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.op1_template_decontamination(spark, SMALL).collect()} == expected


# -- 2 -----------------------------------------------------------------------


def test_language(spark, odd_rows):
    docs = documents(spark)
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.op2_word_first_language(spark, SMALL).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(true) and {r["doc_id"] for r in held} == {d for d in true if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    model = language.fit(docs)
    odd = language.identify(odd_rows, model).collect()
    assert len(odd) == 9 and {r["lang_pred"] for r in odd if r["doc_id"] in (2, 3, 4, 6)} == {"und"} and all(r["score"] == 0 for r in odd if r["lang_pred"] == "und")
    nothing = language.identify(odd_rows, language.fit(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    kept = language.accepted(odd_rows, model)
    assert kept.schema == odd_rows.schema and kept.where("doc_id in (2, 3, 4, 6)").count() == 0


def test_texts_without_letters(spark):
    model = language.Model(["de", "en"], np.array([5.0, 5.0]), {"schule": np.array([9.0, 0.0]), "school": np.array([0.0, 9.0])})
    odd = ["² ½ Ⅳ ①", "٣ 4 ५", "_ -", "", None, "x²", "ªb", "学校"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert [got[k] == "und" for k in range(len(odd))] == [not any(c.isalpha() for c in t or "") for t in odd]


def plain_model(rows, langs):
    """Word and n-gram log frequencies, counted without Spark."""
    words = {x: Counter() for x in langs}
    for _, t, lang in rows:
        words[lang].update("".join(c if c.isalpha() else " " for c in t.lower()).split())
    every = sorted({w for c in words.values() for w in c})
    counts = {w: np.array([words[x][w] for x in langs], float) for w in every}
    total = sum(counts.values())
    logs = {w: np.log((c + 0.05) / (total + 0.05 * len(every) + 1)) for w, c in counts.items()}
    grams = {}
    for n in range(1, language.MAX_GRAM + 1):
        own = {}
        for w, c in counts.items():
            for g in language.grams(w, n):
                own[g] = own.get(g, 0) + np.log1p(c)
        whole = sum(own.values())
        grams[n] = {g: np.log((c + 0.05) / (whole + 0.05 * len(own))) for g, c in own.items()}

    def of_word(w):
        if w in logs:
            return logs[w]
        for n in range(min(language.MAX_GRAM, len(w) + 2), 0, -1):
            known = [grams[n][g] for g in language.grams(w, n) if g in grams[n]]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    n = np.array([sum(x == lang for _, _, x in rows) for lang in langs], float)
    prior = np.log((n + 1) / (n + 1).sum())

    def predict(t):
        found = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not found:
            return "und", 0.0
        z = sum(map(of_word, found)) + prior
        p = np.exp(z - z.max())
        return langs[int(np.argmax(z))], float((p / p.sum()).max())

    return predict


def test_language_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents(spark).where("lang is not null").orderBy("doc_id").limit(90).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    predict = plain_model(fold, sorted({x for _, _, x in fold}))
    got = language.identify(docs, language.fit(docs)).collect()
    for r in got:
        lang, score = predict(dict((d, t) for d, t, _ in rows)[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3


def test_backoff():
    model = language.Model(["de", "en"], np.array([5.0, 5.0]), {"schule": np.array([9.0, 0.0]), "school": np.array([0.0, 9.0])})
    predict = language._Predictor(model)
    assert predict(["school", "schulen", "schoolish", "xyz"])[0][:3] == ["en", "de", "en"]


def test_no_language_loses_its_words_to_another(spark):
    rows = [(4 * k, " ".join(f"{chr(97 + j)}{chr(97 + k)}" for j in range(20)) + " ", "en") for k in range(20)] * 5 + [(3, "żółw żaba", "pl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))), max_words=20)
    assert {"żółw", "żaba"} <= set(model.words) and len(model.words) == 12
    assert "żó" in model.grams[2] and "nb" in model.grams[2]  # n-grams of all words, also those without a row


# -- 3 -----------------------------------------------------------------------


def check_packing(rows, ids_of):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        own = ids_of[doc]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(own) and zlib.crc32(own[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_packing(spark, odd_rows):
    check_packing(packing.op3_sum_of_squares_packing(spark, SMALL).collect(), {d: encoded(tokens.WORD_BPE, t, 1) for d, t in texts(spark).items()})
    odd = packing.pieces_digest(odd_rows.where("doc_id <> 1 or doc_id is null")).collect()
    check_packing(odd, {r["doc_id"]: encoded(tokens.WORD_BPE, r["text"] or "", 1) for r in odd_rows.collect() if r["doc_id"] != 1})
    assert packing.pieces_digest(odd_rows.limit(0)).count() == 0
    twice = packing.pieces_digest(odd_rows.where("doc_id = 1")).collect()  # cut freely, so there may be more pieces than rows
    places = sorted(p for r in twice for p in range(r["start"], r["start"] + r["length"]))
    assert {r["doc_tokens"] for r in twice} == {len(places) // 2} and places == sorted([*range(len(places) // 2)] * 2)
    own = encoded(tokens.WORD_BPE, odd_rows.where("doc_id = 1").first()["text"], 1)
    assert all(r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) for r in twice) and len(own) == len(places) // 2


def test_sum_of_squares_rule():
    rng = random.Random(1)
    packer = packing.SumOfSquares(16, 10_000)
    for _ in range(400):
        size = rng.randint(1, 15)
        def after(level):
            count = packer.count.copy()
            count[level] -= level > 0
            count[level + size] += level + size < 16
            return int((count[1:16] ** 2).sum())
        choices = [0, *(h for h in range(1, 17 - size) if packer.count[h])]
        assert after(packer.level(size)) == min(map(after, choices))
        list(packer.add((0, 0, np.zeros(size, "<u4"), size)))
    bounded = packing.SumOfSquares(16, 40)
    whole = [x for _ in range(50) for x in bounded.add((0, 0, np.zeros(9, "<u4"), 9))] + list(bounded.close())
    assert sum(len(p[2]) for s in whole for p in s) == 450 and bounded.held <= 40


# -- 4 -----------------------------------------------------------------------


def test_matroska(spark, odd_rows):
    def payload(t):
        raw = (t or "").encode()
        return raw + b"\xff" * (-(-max(1, len(raw)) // 576) * 576 - len(raw)), len(raw)

    for rows, source in ((matroska.op4_matroska_media(spark, SMALL).collect(), documents(spark)), (matroska.media_column(odd_rows).mapInArrow(matroska._digest, matroska.DIGEST).collect(), odd_rows)):
        expected = sorted((hashlib.sha256(p).hexdigest(), len(p), n, zlib.crc32(p[-32:])) for p, n in (payload(r["text"]) for r in source.collect()))
        assert sorted((r["payload_sha256"], r["payload_bytes"], r["n_bytes"], r["tail_crc32"]) for r in rows) == expected
    assert matroska.packet_table(matroska.media_column(odd_rows.limit(0))).count() == 0
    packets = matroska.packet_table(matroska.media_column(documents(spark).where("doc_id = 0"))).orderBy("packet").collect()
    assert [r["timestamp"] for r in packets] == [576 * k for k in range(len(packets))] and {r["track"] for r in packets} == {1}


def test_matroska_parser():
    m = matroska
    block = lambda kind, body, flags=0: m.element(kind, b"\x81\x00\x05" + bytes([flags]) + body)
    xiph = block(m.SIMPLE_BLOCK, b"\x02" + bytes([255, 45, 3]) + b"a" * 300 + b"bbb" + b"cc", 0x80 | 1 << 1)
    ebml = block(m.SIMPLE_BLOCK, b"\x02" + m.size_field(4) + bytes([0x80 | (63 - 2)]) + b"dddd" + b"ee" + b"f", 3 << 1)
    fixed = m.element(m.BLOCK_GROUP, block(m.BLOCK, b"\x01" + b"gghh", 2 << 1))
    head = m.element(m.INFO, m.number(m.TIMESTAMP_SCALE, 1000)) + m._TRACKS
    unknown = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.TIMESTAMP, 100) + xiph + m.element(m.VOID, b"xyz")
    second = m.element(m.CLUSTER, m.number(m.TIMESTAMP, 200) + ebml + fixed)
    data = m._HEADER + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + head + unknown + second
    media = m.parse(data)
    assert [data[a:b] for _, _, a, b, _, _ in media.packets] == [b"a" * 300, b"bbb", b"cc", b"dddd", b"ee", b"f", b"gg", b"hh"]
    assert [p[1] for p in media.packets][:1] == [105] and media.packets[3][1] == 205 and [p[5] for p in media.packets] == [0, 0, 0, 1, 1, 1, 1, 1]
    assert media.lacings == {1, 2, 3} and [p[4] for p in media.packets] == [True] * 3 + [False] * 3 + [True] * 2
    for broken in (b"", b"\x00", data[:60], b"RIFF" + data[4:]):
        with pytest.raises(ValueError):
            m.parse(broken)
    long = m.mux(b"x" * 576 * 130)
    parsed = m.parse(long)
    assert m.payload_of(long, parsed) == b"x" * 576 * 130 and len(parsed.clusters) == 3 and all(dict(parsed.clusters)[at] == when for when, _, at in parsed.cues)
    assert [m.vint(m.size_field(n), 0, False)[0] for n in (0, 126, 127, 16382, 16383, 10**9)] == [0, 126, 127, 16382, 16383, 10**9]


def test_broken_media():
    rng = random.Random(4)
    whole = matroska.mux(b"x" * 1152)
    for _ in range(3000):
        raw = bytearray(whole[: rng.randint(0, len(whole))])
        for _ in range(rng.randint(0, 6)):
            if raw:
                raw[rng.randrange(min(len(raw), 400))] = rng.randrange(256)
        try:
            matroska.parse(bytes(raw))
        except ValueError:
            pass


# -- 5 -----------------------------------------------------------------------


def test_pseudo_likelihood(spark, odd_rows):
    p = pseudo_likelihood
    rng = np.random.default_rng(0)
    net = p.start().astype(np.float64)
    target, around = rng.integers(0, p.VOCABULARY, 20), rng.integers(0, p.VOCABULARY + 1, (20, 2 * p.SIDE))
    moved = net.copy()
    p.train_step(p.opened(moved), target, around, 1e-4)
    slope = (net - moved) / 1e-4
    loss = lambda v: -p.log_probabilities(p.opened(v), target, around).mean()
    for k in rng.choice(np.flatnonzero(np.abs(slope) > 1e-4), 10):
        up, down = net.copy(), net.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - slope[k]) < 1e-3
    whole = np.array([np.exp(p.log_probabilities(p.opened(net), np.arange(p.VOCABULARY), np.repeat(around[:1], p.VOCABULARY, 0))).sum()])
    assert abs(whole[0] - 1) < 1e-6
    docs = documents(spark).select("doc_id", "text")
    vocab = p.vocabulary(docs.select("text"))
    trained = p.train(docs.select("text"), vocab, share=1)
    score = lambda n: docs.transform(lambda d: p.score(d, vocab, n)).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert score(trained) > score(p.start()) + 0.2
    odd = {r["doc_id"]: r for r in p.pseudo_likelihood(odd_rows).collect()}
    assert odd[2]["n_tokens"] == 0 and odd[2]["log_likelihood"] == 0 and odd[2]["mean_log_likelihood"] is None and odd[5]["log_likelihood"] < 0
    assert p.pseudo_likelihood(odd_rows.limit(0)).count() == 0


def test_pseudo_likelihood_trains_on_all_documents(spark):
    p = pseudo_likelihood
    few = documents(spark).select("text").where(F.pmod(F.xxhash64("text"), F.lit(40)) != 0).limit(60).coalesce(1).cache()
    vocab = p.vocabulary(few)
    network = p.train(few, vocab)
    assert not np.array_equal(network, p.start()) and np.allclose(network, p.train(few, vocab, share=1), atol=1e-5)
    assert not np.array_equal(p.train(few, vocab, share=40), p.start())


def test_pseudo_likelihood_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_TOKENS", 4000)
    docs = documents(spark).select("doc_id", "text").orderBy("doc_id").limit(60).cache()
    scores = []
    for n in (1, 5):
        rows = pseudo_likelihood.pseudo_likelihood(docs.repartition(n)).collect()
        scores.append(sorted((r["doc_id"], r["n_tokens"], r["log_likelihood"]) for r in rows))
    assert np.allclose(*(np.array(x, float) for x in scores), rtol=1e-5)


def test_pseudo_likelihood_by_brute_force(spark):
    """Each token by itself, from both sides, with plain loops."""
    p = pseudo_likelihood
    docs = documents(spark).select("doc_id", "text").where("length(text) < 900").orderBy("doc_id").limit(12).cache()
    vocab = p.vocabulary(documents(spark).select("text"))
    flat = p.train(docs, vocab)
    net = {k: v.astype(float) for k, v in p.opened(flat).items()}
    counts = Counter(w for r in documents(spark).collect() for w in p.tokens(r["text"]))
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for r in p.score(docs, vocab, flat).collect():
        own = p.tokens(docs.where(F.col("doc_id") == r["doc_id"]).first()["text"])
        ids, total = [vocab[w] for w in own], 0.0
        for k, w in enumerate(own):
            sides = [ids[j] if 0 <= j < len(ids) else p.PAD for j in (*range(k - p.SIDE, k), *range(k + 1, k + p.SIDE + 1))]
            h = np.maximum(np.concatenate([net["embedding"][j] for j in sides]) @ net["inner"] + net["inner_bias"], 0)
            c, place = divmod(ids[k], p.VOCABULARY // p.CLASSES)
            total += np.log(softmax(h @ net["class"] + net["class_bias"])[c]) + np.log(softmax(h @ net["word"][c] + net["word_bias"][c])[place])
            if vocab.shared[ids[k]]:
                total += np.log(counts[w] + p.SMOOTH) - vocab.totals[ids[k]]
        assert r["n_tokens"] == len(own) and abs(r["log_likelihood"] - total) < 1e-3 * max(1, abs(total))


@pytest.mark.parametrize("common", [0, 700])
def test_pseudo_likelihood_of_words_in_buckets(spark, monkeypatch, common):
    p = pseudo_likelihood
    monkeypatch.setattr(p, "COMMON", common)
    docs = documents(spark).select("doc_id", "text").limit(80)
    counts = Counter(w for r in docs.collect() for w in p.tokens(r["text"]))
    vocab = p.vocabulary(docs.select("text"))
    total, types = Counter(), Counter()
    for w, n in counts.items():
        if vocab.shared[vocab[w]]:
            total[vocab[w]] += n
            types[vocab[w]] += 1
    often, seldom = (f(((n, w) for w, n in counts.items() if vocab.shared[vocab[w]] and types[vocab[w]] > 1))[1] for f in (max, min))
    share = lambda w: np.log((counts[w] + p.SMOOTH) / (total[vocab[w]] + p.SMOOTH * (types[vocab[w]] + 1)))
    unseen = next(w for w in (f"zq{k}x{often[-1]}" for k in range(10**4)) if w not in counts and p.tokens(w) == [w] and total[vocab[w]])
    rows = [(1, often), (1, seldom), (None, f"{often} {seldom} {seldom}"), (3, unseen)]
    flat = np.zeros_like(p.start())  # every id has the probability 1 / VOCABULARY
    got = [r["log_likelihood"] for r in p.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), vocab, flat).orderBy(F.col("doc_id").asc_nulls_last(), F.desc("log_likelihood")).collect()]
    base = -np.log(p.VOCABULARY)
    want = sorted([share(often) + base, share(seldom) + base], reverse=True) + [share(unseen) + base, share(often) + 2 * share(seldom) + 3 * base]
    assert np.allclose(got, want, atol=1e-4)


def test_pseudo_likelihood_cuts_many_texts_at_once():
    p = pseudo_likelihood
    texts = ["The quick, brown_fox", "", "İstanbul ΑΣ Σ", "ÀB12́ ก็ดี 😀😀 a😀b", "c\x1cd\x85e\u2028f", "\n_\r", "ß𝔘𝟘 ²½Ⅷ", " ", "the the THE"]
    for own in (texts, texts[::-1], [], [""], *([t] for t in texts)):
        sizes, numbers, words = p.cut(own)
        words, want = words.to_pylist(), [p.tokens(t) for t in own]
        assert sizes.tolist() == [*map(len, want)] and [words[k] for k in numbers] == [w for t in want for w in t] and len({*words}) == len(words)


def test_pseudo_likelihood_without_tokens(spark):
    rows = pseudo_likelihood.pseudo_likelihood(spark.createDataFrame([(1, None), (2, ""), (None, " \n")], "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"] or 0, *r[1:]) for r in rows) == [(k, 0, 0.0, None) for k in range(3)]


@pytest.mark.parametrize("scale", [1, 300])
def test_pseudo_likelihood_descends_as_one_batch_after_another(scale):
    """Classes with many, few and no rows, a last batch that is not full, and numbers whose exponentials overflow."""
    p = pseudo_likelihood
    rng = np.random.default_rng(3)
    per, size, n = p.VOCABULARY // p.CLASSES, 64, 150
    target = np.where(rng.random(n) < 0.5, rng.integers(0, per, n), rng.integers(0, p.VOCABULARY, n))
    around, order = rng.integers(0, p.VOCABULARY + 1, (n, 2 * p.SIDE)), rng.permutation(n)
    got, want = p.start().astype(float) * scale, p.start().astype(float) * scale
    net = p.opened(want)
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for k in range(0, n, size):
        own, steps = order[k : k + size], {name: np.zeros(shape) for name, shape in p.SHAPES.items()}
        for t, ids in zip(target[own], around[own]):
            c, place = divmod(t, per)
            x = net["embedding"][ids].ravel()
            h = np.maximum(x @ net["inner"] + net["inner_bias"], 0)
            of_class, of_word = softmax(h @ net["class"] + net["class_bias"]), softmax(h @ net["word"][c] + net["word_bias"][c])
            of_class[c] -= 1
            of_word[place] -= 1
            back = (net["class"] @ of_class + net["word"][c] @ of_word) * (h > 0)
            for name, at, step in (("class", ..., np.outer(h, of_class)), ("class_bias", ..., of_class), ("word", c, np.outer(h, of_word)), ("word_bias", c, of_word), ("inner", ..., np.outer(x, back)), ("inner_bias", ..., back)):
                steps[name][at] += step
            np.add.at(steps["embedding"], ids, (net["inner"] @ back).reshape(-1, p.WIDTH))
        for name, step in steps.items():
            net[name] -= 0.1 / len(own) * step
    p.descend(p.opened(got), target, around, 0.1, order, size)
    assert not np.allclose(got, p.start() * scale) and np.allclose(got, want, rtol=1e-6, atol=1e-8)


# -- 6 and 10 ----------------------------------------------------------------


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def plain_secrets(t):
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[1]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_personal(t):
    only = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    found += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(only(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], pii.BASE.index(x[2])))


def test_base_spans():
    rng = random.Random(5)
    parts = ["password", "TOKEN", " ", " = ", ":", '"', "a", "b9", "AKIA", "ABCDEF12", "deadbeef", "0123456789abcdef", "@", "a.b", ".", "1", "25", "300", "-", "+", "(", ")", "4111", "x@", "\n", "é", "ſecret", "ToKen"]
    for _ in range(30_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert secrets.base_spans(t) == plain_secrets(t) and pii.base_spans(t) == plain_personal(t)


def test_secrets(spark, odd_rows):
    novel = 'config: credential for the service is "q7Zp2Lx9Vt4Rb8Nw3Kd6" and the credential default_placeholder_name1'
    spans = secrets.all_spans(novel)
    assert [novel[a:b] for a, b, k in spans] == ["q7Zp2Lx9Vt4Rb8Nw3Kd6"]
    docs = texts(spark)
    for r in secrets.op6_secret_novelty(spark, SMALL).collect():
        base = plain_secrets(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest() and r["n_hex"] == sum(k == "hex" for _, _, k in base)
        assert set(filter(None, listed(base).split(","))) <= set(r["spans"].split(","))
    clean = secrets.redacted(odd_rows)
    assert clean.schema == odd_rows.schema and clean.count() == 9 and clean.where("doc_id = 7").first()["text"] == "😀 é ñ [SECRET]"
    assert secrets.find_secrets(odd_rows).count() == 9 and secrets.find_secrets(odd_rows.limit(0)).count() == 0
    assert secrets.mask("abcdef", [(1, 3, "x"), (2, 4, "y")], "#") == "a#ef"


def test_secrets_in_labelled_examples():
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strings = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 44))) for _ in range(300)]
    strings = [x for x in strings if any(map(str.isdigit, x)) and any(map(str.isalpha, x))]
    names = ["_".join(rng.choice(sorted(secrets._NAMES)) for _ in range(4)) + str(rng.randint(0, 99)) for _ in range(300)]
    found = lambda x: any(k == "novel" for _, _, k in secrets.all_spans(f"the credential is {x} for the login"))
    assert np.mean([*map(found, strings)]) > 0.97 and np.mean([*map(found, [n for n in names if len(n) > 15])]) < 0.02


def plain_novel(t):
    """The method's spans by looking at every pair of a word and a string."""
    base, found = plain_secrets(t), []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", t):
        near = any(0 <= m.start() - w.end() <= secrets.CONTEXT for w in secrets._SENSITIVE.finditer(t))
        clear = not any(a < m.end() and m.start() < b for a, b, _ in base)
        if len(m[0]) >= 16 and near and clear and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            rest = secrets.rest_of(m[0])
            if len(rest) >= secrets.REST and secrets.marginal_bytes(t, m.start(), m.end(), rest) >= secrets.NOVELTY * len(rest):
                found.append((m.start(), m.end(), "novel"))
    return found


def test_novel_spans():
    rng = random.Random(6)
    parts = ["password", "TOKEN", "bearer ", " ", " = ", "q7Zp2Lx9Vt4Rb8Nw3Kd6", "default_value_name12", "zzzzzzzzzzzzzzzz1", "\n", " word ", "x" * 40 + " "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.novel_spans(t, secrets.base_spans(t)) == plain_novel(t)


def test_long_texts_of_spans_take_linear_time():
    import time

    began = time.time()
    assert secrets.all_spans("token " * 170_000) == []
    many = "token = abcdefgh12 " * 10_000
    assert len(secrets.all_spans(many)) == 10_000
    assert len(secrets.all_spans("token q7Zp2Lx9Vt4Rb8Nw3Kd6 " * 3_000)) > 0
    weights = pii.train(["email"], np.array([[1, 1, 1, 0, 0]]), np.array([5.0]))
    assert len([x for x in pii.all_spans("Mr. John Smith a@b.com 212-555-1234 " * 10_000, weights) if x[2] == "email"]) == 10_000
    assert time.time() - began < 20


def plain_wide(t, weights):
    base, out = plain_personal(t), []
    for a, b, kind in sorted(pii.wide_spans(t)):
        sure = 1 / (1 + np.exp(-(pii.features([kind], np.array([pii.votes(t, a, b, kind)])) @ weights)[0]))
        if sure >= pii.THRESHOLD and not any(x < b and a < y for x, y, _ in base + out):
            out.append((a, b, kind))
    return sorted(base + out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_wide_spans():
    rng = random.Random(9)
    kinds = [k for k in pii.KINDS for _ in range(4)]
    patterns = np.array([[rng.choice((-1, 0, 1)) for _ in pii.LABELERS] for _ in kinds])
    weights = pii.train(kinds, patterns, np.ones(len(kinds)))
    parts = ["Mr. John Smith", " ", "Dr Anna", "212-555-1234", "call (212) 555-1234", "123-45-6789", "ssn ", "DE89 3704 0044 0532 0130 00", "a@b.com", "order no. ", "10.0.0.1", "+1 212 555 1234", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert pii.all_spans(t, weights) == plain_wide(t, weights)


def test_personal(spark, odd_rows):
    docs = texts(spark)
    for r in pii.op10_weak_supervision(spark, SMALL).collect():
        base = plain_personal(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(filter(None, listed(base).split(","))) <= set(r["spans"].split(","))
    assert pii.find_personal(odd_rows).count() == 9 and pii.find_personal(odd_rows.limit(0)).count() == 0
    long = "a" * 200_000 + "@" + "1" * 200_000
    assert pii.base_spans(long) == []


def test_expectation_maximisation():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.3
    good = [0.9, 0.8, 0.75, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(4000) < 0.2, 0, np.where((rng.random(4000) < g) == truth, 1, -1)) for g in good], axis=1)
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, share, table = pii.reliabilities(patterns, n.astype(float))
    assert abs(share - 0.3) < 0.08 and np.mean((p[back.ravel()] >= 0.5) == truth) > 0.88
    assert table[1, 0, 2] > table[1, 4, 2]
    weights = pii.train(["email"] * len(patterns), patterns, n.astype(float))
    sure = 1 / (1 + np.exp(-pii.features(["email"] * len(patterns), patterns) @ weights))
    assert np.mean((sure[back.ravel()] >= 0.5) == truth) > 0.87


# -- 7 -----------------------------------------------------------------------


def test_token_files(spark, odd_rows):
    at = 0
    rows = {r["doc_id"]: r for r in token_files.op7_token_files(spark, SMALL).collect()}
    for doc, text in sorted(texts(spark).items()):
        own = encoded(tokens.BYTE_BPE, text, 2)
        assert (rows[doc]["start"], rows[doc]["n_tokens"], rows[doc]["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    path = token_files.shared_dir(spark)
    token_files.write_token_files(odd_rows, path, file_ids=1000)
    back = token_files.read_token_files(spark, path).orderBy("start").collect()
    expected = sorted(((token_files.LAST_ID if r["doc_id"] is None else r["doc_id"]), encoded(tokens.BYTE_BPE, r["text"] or "", 2).tolist()) for r in odd_rows.collect())
    assert [(r["doc_id"], r["ids"]) for r in back] == expected and [r["start"] for r in back] == np.cumsum([0, *(len(x) for _, x in expected)])[:-1].tolist()
    path = token_files.shared_dir(spark)
    token_files.write_token_files(odd_rows.limit(0), path)
    assert token_files.read_token_files(spark, path).count() == 0


@pytest.mark.parametrize("bits,most", [(1, 1 << 16), (2, 1 << 32)])
def test_coding(bits, most):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ranks = (most ** rng.random(n)).astype(np.uint64).clip(0, most - 1).astype(np.uint32)
        assert (token_files.decode_ranks(*token_files.encode_ranks(ranks, bits), n, bits) == ranks).all()


# -- 8 -----------------------------------------------------------------------


def plain_components(rows, percent=85):
    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), d), d)
    return sorted((d, len(sets[k]), least[top(k)] if sets[k] else d) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("small,block", [(16, 512), (2, 3)])
def test_near_duplicates(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 8)):
            w = base[:]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("QRST")
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, ""), (1001, None), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1004, "a B")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_at_a_threshold(spark):
    rows = []
    for k in range(40):  # 96 shingles each; the pair shares 86 of 106, a similarity of 0.811
        words = [f"w{k}x{j}" for j in range(100)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:90] + [f"v{k}x{j}" for j in range(10)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = lambda *at: {r["doc_id"] for r in minhash.near_duplicates(docs, *at).where("not kept").collect()}
    assert gone() == set() and gone(80) == {2 * k + 1 for k in range(40)}
    assert [(t.rows, t.bands, t.least) for t in map(minhash.Threshold, (85, 80))] == [(5, 28, 93), (4, 35, 83)]


def test_near_duplicates_of_odd_rows(spark, odd_rows):
    got = minhash.near_duplicates(odd_rows).collect()
    assert len(got) == 9 and [r["kept"] for r in got if r["doc_id"] is None] == [True] and minhash.near_duplicates(odd_rows.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    for share in (0.3, 0.85):
        both = int(2000 * 2 * share / (1 + share))
        b = np.r_[a[:both], rng.integers(0, 1 << 63, 2000 - both).astype(np.uint64)]
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - share) < 0.13


# -- 9 -----------------------------------------------------------------------


def plain_removal(rows):
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    key = [substrings.LAST_ID if d is None else d for d, _ in rows]
    for k, w in enumerate(words):
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), []).append((key[k], k, p))
    out = []
    for k, w in enumerate(words):
        gone = set()
        for p in range(len(w) - 19):
            if any(d < key[k] or (j == k and q < p) for d, j, q in first[tuple(w[p : p + 20])]):
                gone.update(range(p, p + 20))
        out.append((rows[k][0], len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_substrings(spark, parts):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcde") for _ in range(60)) for _ in range(5)]
    rows = []
    for k in range(60):
        b, a = rng.choice(base).split(" "), rng.randrange(30)
        rows.append((rng.choice([k, k, k, None, 7]), " ".join(b[a : a + rng.randint(5, 40)] * rng.choice([1, 1, 2]) + [rng.choice("xyz") for _ in range(rng.randint(0, 10))])))
    rows += [(3, None), (4, ""), (5, "a b c"), (9, "z " * 300), (10, "z " * 300), (10, "z " * 300), (11, "long " * 10), (12, "long " * 10)] + [(100 + k, base[0]) for k in range(5)]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=order) == sorted(plain_removal(rows), key=order)
    assert all(sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"] for r in got)


def test_substrings_of_many_rows_without_ids(spark):
    rng = random.Random(3)
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(None, " ".join(f"x{k}y{j}" for j in range(25)) + (" " + base if k % 2 else "")) for k in range(200)] + [(1, base)] + [(None, "same " * 30)] * 50
    rng.shuffle(rows)
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=order) == sorted(plain_removal(rows), key=order)


def test_substrings_of_odd_rows(spark, odd_rows):
    assert substrings.deduplicated(odd_rows).count() == 9 and substrings.deduplicated(odd_rows.limit(0)).count() == 0


def test_rolling_hash():
    h = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64)
    for n in (1, 2, 5, 8, 20):
        base = 0x9E3779B97F4A7C15
        expected = [sum(int(x) * pow(base, n - 1 - k, 1 << 64) for k, x in enumerate(h[a : a + n])) % (1 << 64) for a in range(51 - n)]
        assert substrings.rolling(h, n, np.uint64(base)).tolist() == expected


# -- SQL ---------------------------------------------------------------------


@pytest.mark.parametrize("name", [*queries.ORACLE_SQL])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SMALL}/documents.parquet')")
    expected = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    rows = sorted(expected.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SMALL).collect()) == rows
