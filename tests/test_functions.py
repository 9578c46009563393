import pytest
from pyspark.sql import functions as F

from lanna.functions import scalar
from lanna.operators import analyzers, filters, retrieval
from lanna.operators.numbers import merge_numbers, parse
from lanna.operators.romanize import by_rules, romanize
from lanna.sources import corpus, dictionary


def applied(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_soundex(spark):
    cases = {"ลัก": "ร100000", "รัก": "ร100000", "รักษ์": "ร100000", "กาล": "ก900000", "การณ์": "ก900000", "พันธ์": "พ300000", "พันธุ์": "พ300000", "บูรณการ": "บ931900", "ปัจจุบัน": "ป775300", "": "", None: ""}
    assert applied(spark, cases, scalar.soundex) == list(cases.values())


def test_keyboard(spark):
    cases = {"l;ylfu": "สวัสดี", "gxHo9ho": "เป็นต้น", "wmp": "ไทย", "1": "ๅ", "!": "+", "0": "จ", ")": "๗", None: None}
    assert applied(spark, cases, scalar.to_kedmanee) == list(cases.values())
    assert applied(spark, ["สวัสดี", "เป็นต้น", "ไทย", "๑", "๒"], scalar.to_qwerty) == ["l;ylfu", "gxHo9ho", "wmp", "@", "#"]
    assert [scalar.direction(x) for x in (None, "TH_TO_EN", "both", "?")] == [scalar.FORWARD, scalar.BACKWARD, scalar.BOTH, scalar.FORWARD]


NUMBERS = {"ศูนย์": 0, "หนึ่ง": 1, "สิบสอง": 12, "ยี่สิบเอ็ด": 21, "ร้อย": 100, "สามร้อยห้าสิบ": 350, "หมื่นห้าพัน": 15000, "หนึ่งแสนสองหมื่น": 120000, "ล้าน": 1000000, "สองล้านสามแสนห้าหมื่น": 2350000, "ยี่สิบล้าน": 20000000, "ล้านล้าน": 10**12, "หนึ่งสอง": 2,
           "เก้าอี้": None, "ร้อยกรอง": None, "บ้าน": None, "": None}


def test_number_words(spark):
    assert applied(spark, NUMBERS, scalar.parse_number_words) == list(NUMBERS.values())
    assert [parse(x) for x in NUMBERS] == list(NUMBERS.values())


def test_number_runs():
    stream = [(w, a, b, 1, 1, "<THAI>") for w, a, b in (("ราคา", 0, 4), ("ห้า", 4, 7), ("หมื่น", 7, 12), ("บาท", 12, 15))]
    kept = merge_numbers(stream, True, True, True, 0)
    assert [t[0] for t in kept] == ["ราคา", "ห้า", "50000", "หมื่น", "บาท"] and kept[2][1:5] == (4, 12, 0, 2)
    assert [t[0] for t in merge_numbers(stream, False, True, True, 0)] == ["ราคา", "50000", "บาท"]
    assert [t[0] for t in merge_numbers([("ห้า", 0, 3, 1, 1, "")], True, True, True, 10)] == ["ห้า"]
    assert [t[0] for t in merge_numbers([("๑๒๕๐", 0, 4, 1, 1, "")], True, True, True, 0)] == ["๑๒๕๐", "1250"]


def test_collation(spark):
    order = "กก กะ กัน กา กำ กิ กี กึ กื กุ กู เก แก โก ใก ไก".split()
    keys = applied(spark, order, scalar.collation_key)
    assert sorted(keys) == keys and len(set(keys)) == len(keys)
    assert applied(spark, ["เกาะ"], scalar.collation_key)[0].startswith("010000030000")
    one = applied(spark, ["เสือ", "เสื่อ", "เสื้อ"], lambda c: scalar.collation_key(c, "primary"))
    three = applied(spark, ["เสือ", "เสื่อ", "เสื้อ"], scalar.collation_key)
    assert len(set(one)) == 1 and sorted(three) == three and len(set(three)) == 3
    assert applied(spark, ["", None], lambda c: scalar.collation_key(c, "primary")) == ["", ""] and applied(spark, [""], scalar.collation_key) == ["000000"]
    am = lambda how: applied(spark, ["กำ", "กํา"], lambda c: scalar.collation_key(c, "tertiary", how))
    assert len(set(am("none"))) == 2 and len(set(am("canonical"))) == 1


def test_romanization():
    assert [by_rules(w) for w in ("กบ", "ไก่", "รักษ์", "สมชาย")] == ["kop", "kai", "rak", "samachai"]
    assert romanize("กรุงเทพ") == ["krungthep", "bangkok"] and romanize("abc") == [] and romanize(None) == []


def run(spark, text, how):
    row = spark.createDataFrame([(text,)], "t string").select(how(F.col("t")).alias("x")).first()
    return [(t["term"], t["pos_inc"], t["type"]) for t in row["x"]]


def test_filters(spark):
    cut = analyzers.segmenter(spark)
    assert [t[0] for t in run(spark, "นะค่ะ", lambda c: filters.tone(cut(c)))][:2] == ["นะค่ะ", "นะคะ"]
    assert run(spark, "รัก", lambda c: filters.soundex(cut(c))) == [("รัก", 1, "<THAI>"), ("ร100000", 0, "<PHONETIC>")]
    assert [t[0] for t in run(spark, "l;ylfu สวัสดี", lambda c: filters.keyboard(F.transform(F.split(c, " "), lambda w: F.struct(w.alias("term"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1).alias("pos_inc"), F.lit(1).alias("pos_len"), F.lit("x").alias("type"))), "both"))] == ["l;ylfu", "สวัสดี", "สวัสดี", "l;ylfu"]
    assert [t[0] for t in run(spark, "กทม.", lambda c: filters.acronym(cut(c)))] == ["กทม.", "กรุงเทพมหานคร"]
    assert [t[0] for t in run(spark, "กรุงเทพมหานคร", lambda c: filters.acronym(cut(c), both_ways=True))] == ["กรุงเทพมหานคร", "กทม."]
    assert [t[0] for t in run(spark, "เชียงใหม่", lambda c: filters.romanization()(cut(c)))] == ["เชียงใหม่", "chiangmai"]
    assert run(spark, "a the b", lambda c: filters.stop(cut(c), ["the"])) == [("a", 1, "<ALPHANUM>"), ("b", 2, "<ALPHANUM>")]


def test_presets(spark):
    person = run(spark, "สนามบิน", analyzers.person_analyzer(spark))
    assert [t[0] for t in person if t[2] == "<PHONETIC>"] and [t[0] for t in person if t[2] == "<THAI>"] == ["สนามบิน", "สนาม", "บิน"]
    assert len([t for t in person if t[2] == "<PHONETIC>"]) == 1
    assert [t[0] for t in run(spark, "นํ้าตาลหวาน ABC", analyzers.analyzer(spark))] == ["น้ำตาล", "หวาน", "abc"]
    chain = analyzers.custom(spark, ["lowercase", "thai_number", "thai_romanization"])
    assert [t[0] for t in run(spark, "ห้า", chain)] == ["ห้า", "ha", "5"]
    with pytest.raises(KeyError):
        analyzers.custom(spark, ["other"])


def test_udtf(spark):
    analyzers.register_udtf(spark)
    assert [r["term"] for r in spark.sql("SELECT term FROM thai_tokens('สนามบิน', 'discard')").collect()] == ["สนาม", "บิน"]


def test_graph_positions(spark):
    df = spark.createDataFrame([(1, "สนามบินไทย")], "k int, t string")
    rows = analyzers.rows(analyzers.analyzed(df, "t", analyzers.segmenter(spark, "mixed")), "k").orderBy("position", F.desc("pos_len")).collect()
    assert [(r["position"], r["term"], r["pos_len"]) for r in rows] == [(0, "สนามบิน", 2), (0, "สนาม", 1), (1, "บิน", 1), (2, "ไทย", 1)]


def test_dictionary_files(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("# words\nซูเปอร์\t2\nกกก\tx\n\n", "utf-8")
    assert {(r["word"], r["weight"]) for r in dictionary.read_words(spark, str(path)).collect()} == {("ซูเปอร์", 2.0), ("กกก", 1.0)}
    assert "ซูเปอร์" in dictionary.load_lexicon(spark, [str(path)], ["ขขข"])
    graph = b"TBD1" + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes([1]) + (0x0E01).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes([0x80])
    (tmp_path / "g.dawg").write_bytes(graph)
    assert dictionary.read_dawg(spark, str(tmp_path / "g.dawg")) == ["ก"]
    for bad in (b"", b"XXXX" + graph[4:], graph[:-1]):
        with pytest.raises(ValueError):
            dictionary.Dawg(bad)
    rules = {r["short"]: r["full"] for r in dictionary.abbreviation_frame(spark, ["มทส.=>x", "y\tz"]).orderBy("rank").collect()}
    assert rules["มทส."] == "x" and rules["y"] == "z" and rules["อ."] == "อำเภอ" and rules["ก.พ."] == "กุมภาพันธ์"
    assert {r["word"]: r["spellings"] for r in dictionary.romanization_frame(spark, ["ก=>A, b,a"]).collect()}["ก"] == ["a", "b"]


def test_tagged_articles(spark, tmp_path):
    (tmp_path / "a1.txt").write_text("นาย\tNN\tB_PER\n_\tPU\tO\nก\tNN\tO\n\n\nข\tVV\tO\nshort\tx\n \tNN\tO\nค\tNN\tO\n", "utf-8")
    (tmp_path / "b.c.txt").write_text("", "utf-8")
    words = corpus.read_tagged(spark, str(tmp_path))
    rows = [(r["article"], r["sentence"], r["word"], r["pos"], r["ne"]) for r in words.orderBy("place").collect()]
    assert rows == [("a1", 0, "นาย", "NN", "B_PER"), ("a1", 0, " ", "PU", "O"), ("a1", 0, "ก", "NN", "O"), ("a1", 1, "ข", "VV", "O"), ("a1", 2, "ค", "NN", "O")]
    assert [r["word"] for r in corpus.listed_words(words, "article").orderBy("place").collect()] == ["นาย", "ก", "ข", "ค"]
    assert corpus.article_text(words, "article").first()["text"] == "นาย ก\nข\nค"


def test_sinks(spark, tmp_path):
    postings = spark.createDataFrame([("a", 1, 2), ("b", 1, 1)], "term string, doc_id long, tf long")
    corpus.write_postings(postings, str(tmp_path / "p"))
    assert sorted(map(tuple, corpus.read_postings(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, postings.collect()))
    corpus.write_bulk(postings.limit(1), "doc_id", "term", "x", str(tmp_path / "b"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "b")).collect()) == ['{"body":"a"}', '{"index":{"_index":"x","_id":"1"}}']
    corpus.write_results(postings, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_tables_from_files(spark, tmp_path):
    short, latin, words, weights = (tmp_path / x for x in ("short.txt", "latin.txt", "words.txt", "weights.txt"))
    short.write_text("# own\nมทส.\tone\nมทส.\ttwo\n", "utf-8")
    latin.write_text("ดีพ\tdeep\n", "utf-8")
    table = dictionary.load_short_forms(spark, str(short), ["ย.=>three"])  # a file takes the place of the bundled table, rules come on top
    assert table == [("มทส.", "one"), ("มทส.", "two"), ("ย.", "three")]
    df = spark.createDataFrame([(w,) for w in ("มทส.", "มทส", "กทม.", "ย.")], "t string")
    token = F.array(F.struct(F.col("t").alias("term"), F.lit(0).alias("start"), F.length("t").alias("end"), F.lit(1).alias("pos_inc"), F.lit(1).alias("pos_len"), F.lit("<THAI>").alias("type")))
    assert [r["x"] for r in df.select(filters.acronym(token, keep=False, table=table)[0]["term"].alias("x")).collect()] == ["two", "two", "กทม.", "three"]
    own = dictionary.load_spellings(spark, str(latin), ["กก=>A,b"])
    assert own == {"ดีพ": ("deep",), "กก": ("a", "b")} and "กรุงเทพ" in dictionary.load_spellings(spark)
    with pytest.raises(Exception):
        dictionary.load_short_forms(spark, str(tmp_path / "missing.txt"))
    graph = b"TBD1" + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes([1]) + (0x0E01).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes([0x80])
    (tmp_path / "g.dawg").write_bytes(graph)
    weights.write_text("ก\t7\n", "utf-8")
    words.write_text("ก\t2\nข\t3\n", "utf-8")
    lexicon = dictionary.load_lexicon(spark, [str(words)], graph=str(tmp_path / "g.dawg"), weights=str(weights))
    assert lexicon.words == {"ก": 2.0, "ข": 3.0} and lexicon.total == 10.0  # a smaller weight counts, the sum doesn't fall
    assert {(r["word"], r["weight"]) for r in dictionary.read_words(spark, str(words)).collect()} == set(dictionary.parse_words(words.read_text("utf-8").splitlines()).items())


def test_entities_end_and_begin_by_the_rule(spark):
    tags = "B_X E_X I_X O I_X B_X I_X B_X I_Y E_Y".split()
    rows = [(1, k, k // 7, w, t) for k, (w, t) in enumerate(zip("abcdefghij", tags))]
    found = retrieval.entities(spark.createDataFrame(rows, "k int, place int, sentence int, word string, ne string"), "k", "place", "sentence")
    assert sorted((r["name"], r["text"]) for r in found.collect()) == [("X", "ab"), ("X", "fg"), ("X", "h")]


def test_phrases_of_a_graph(spark):
    docs = spark.createDataFrame([(1, "ฉันเดินทางไปสนามบินสุวรรณภูมิวันนี้"), (2, "เด็กๆ นั่งดูเครื่องบินที่สนามเด็กเล่นอย่างมีความสุข")], "k int, t string")
    rows = analyzers.rows(analyzers.analyzed(docs, "t", analyzers.analyzer(spark, "mixed")), "k")
    phrases = ["สนามบิน", "สนาม บิน", "ไป สนามบิน", "ฉัน สุวรรณภูมิ"]
    query = spark.createDataFrame([(p, k, w) for p in phrases for k, w in enumerate(p.split(" "))], "q string, place int, term string")
    assert sorted((r["q"], r["k"]) for r in retrieval.phrase(rows, query, "k").collect()) == sorted([("สนามบิน", 1), ("สนาม บิน", 1), ("ไป สนามบิน", 1)])


def test_query_candidates(spark):
    words = spark.createDataFrame([(a, w, p, n) for a in (1, 2) for w, p, n in (("ตลาด", "NN", "O"), ("กา", "NN", "O"), ("บ้าน", "XX", "O"), ("นาย", "NN", "B_PER"))] + [(3, "สนาม", "NN", "O")], "k int, word string, pos string, ne string")
    assert [tuple(r) for r in retrieval.query_words(words, "k").collect()] == [("ตลาด", 2)]
    found = spark.createDataFrame([(k, "PER", t) for k in (1, 2) for t in ("นาย", "สมชาย", "ab")], "k int, name string, text string")
    assert [tuple(r) for r in retrieval.query_entities(found, "k").collect()] == [("สมชาย", "PER", 2)]


def test_metrics_of_queries_without_relevant_rows(spark):
    results = spark.createDataFrame([(1, 10, 1), (2, 10, 1)], "q int, k int, rank int")
    relevant = spark.createDataFrame([(1, 10)], "q int, k int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    assert sorted(tuple(r) for r in retrieval.precision_recall(results, relevant, "k", asked).collect()) == [(1, 1.0, 1.0, 1.0, False), (2, 0.0, 0.0, 0.0, False), (3, 0.0, 0.0, 0.0, True)]
    assert sorted(tuple(r) for r in retrieval.ndcg(results, relevant, "k", asked=asked).collect()) == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_long_token_lists_take_linear_time(spark):
    import time

    docs = spark.createDataFrame([(1, "a the " * 30_000)], "k int, t string")
    began = time.time()
    how = lambda c: filters.soundex(filters.stop(analyzers.segmenter(spark)(c), ["the"]))
    got = analyzers.rows(analyzers.analyzed(docs, "t", how), "k").agg(F.count("*"), F.max("position")).first()
    assert tuple(got) == (30_000, 59_998) and time.time() - began < 30


def test_recommended_order(spark):
    how = analyzers.recommended(spark, ["thai_romanization", "lowercase", "thai_keyboard_text"])
    assert [t[0] for t in run(spark, "l;ylfu", how)] == ["สวัสดี", "sawatdi"]
    with pytest.raises(KeyError):
        analyzers.recommended(spark, ["other"])


def test_keywords_keep_their_spelling():
    step = filters.normalization()
    assert [t[0] for t in step.rows([("นํ้า", 0, 4, 1, 1, "<THAI>"), ("นํ้า", 0, 4, 1, 1, filters.KEYWORD)])] == ["น้ำ", "นํ้า"]


def test_lower_case_by_characters(spark):
    assert applied(spark, ["İSTANBUL ΟΔΟΣ Éa", None], scalar.lower) == ["istanbul οδοσ éa", None]


def test_least_length_counts_utf16_units(spark):
    token = lambda c: F.array(F.struct(c.alias("term"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1).alias("pos_inc"), F.lit(1).alias("pos_len"), F.lit("x").alias("type")))
    assert [t[0] for t in run(spark, "😀a", lambda c: filters.keyboard(token(c), least=3))] == ["😀a", "😀ฟ"]
    assert [t[0] for t in run(spark, "éa", lambda c: filters.keyboard(token(c), least=3))] == ["éa"]


def test_a_lexicon_is_reloaded_in_batch_jobs(spark):
    lexicon = dictionary.Lexicon({"กบ": 1.0})
    how = analyzers.reloadable(spark, lambda: lexicon)
    df = spark.createDataFrame([("กบขาว",)], "t string")
    first = [t["term"] for t in df.select(how(F.col("t")).alias("x")).first()["x"]]
    lexicon.add("กบขาว", 5.0)
    assert first == ["กบ", "ขาว"] and [t["term"] for t in df.select(how(F.col("t")).alias("x")).first()["x"]] == ["กบขาว"]


def test_text_without_thai_stays_native(spark):
    df = spark.createDataFrame([("a b-c 1.5% é",), ("กบ ab",), (None,)], "t string")
    assert [r["x"] for r in df.select(analyzers.all_terms(spark, F.col("t")).alias("x")).collect()] == [["a", "b-c", "1.5%", "é"], ["กบ", "ab"], []]


def test_null_token_lists(spark):
    df = spark.createDataFrame([(1, "a the b"), (2, None), (3, "")], "k int, t string").select("k", F.when(F.col("k") != 2, analyzers.segmenter(spark)(F.col("t"))).alias("x"))
    steps = (lambda c: filters.stop(c, ["the"]), filters.soundex, filters.number(), filters.normalization(), filters.romanization(), filters.lowercase, filters.acronym, filters.collation)
    for step in steps:
        got = {r["k"]: r["y"] for r in df.select("k", step(F.col("x")).alias("y")).collect()}
        assert not got[2] and got[3] == [] and got[1]
    assert analyzers.rows(df.withColumnRenamed("x", "tokens"), "k").count() == 3


def test_a_batch_is_cut_in_portions():
    import pyarrow as pa

    from lanna.operators.segment import tokens

    texts = [None, "", "a b", *["one two three " * 200] * 600, "x " * filters.AT_ONCE, *[f"{k} a" for k in range(50)] * 2]
    calls = []
    arrays = list(analyzers.cut_portions(iter([pa.array(texts, pa.string())]), lambda t: calls.append(t) or tokens(t)))
    assert sum(map(len, arrays)) == len(texts)
    assert max(len(a.flatten()) for a in arrays if len(a) > 1) <= filters.AT_ONCE and len(calls) < 80
    terms = [[t["term"] for t in row] for a in arrays for row in a.to_pylist() if len(row) < 9]
    assert terms == [[], [], ["a", "b"], *[[str(k), "a"] for k in range(50)] * 2]


def shuffles(df, kind="hashpartitioning"):
    """How many exchanges of a kind the plan has before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange {kind}")


def test_segmentations_are_compared_without_a_shuffle(spark):
    from lanna.plans.catalog import segmentation_f1

    texts = spark.createDataFrame([(1, [(0, 2), (3, 5)], [(0, 2), (3, 9)]), (1, [(0, 2)], [(0, 2)]), (None, [], [(4, 6)])], "k int, a array<struct<x:int,y:int>>, b array<struct<x:int,y:int>>")
    spans = [F.transform(c, lambda x: retrieval.span(x["x"], x["y"])).alias(c) for c in "ab"]
    assert tuple(retrieval.span_f1(texts.select(*spans), "a", "b").first()) == (0.666667, 0.5, 0.571429)
    assert shuffles(segmentation_f1(spark, "/root/testdata/sf0.001")) == 0


@pytest.mark.parametrize("name", ["number_sequence_merge", "dictionary_prefix_matches", "soundex_codes"])
def test_small_tables_are_dealt_to_all_cores(spark, name):
    import __spark_entry__ as entry

    made = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert shuffles(made, "RoundRobinPartitioning") and not shuffles(made)


def test_the_rules_of_a_code_are_applied_once(spark):
    plan = spark.range(1).select(scalar.soundex(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= len(scalar.SOUND_RULES)


@pytest.mark.parametrize("name, most", [("bm25_top10", 1), ("layered_should", 1), ("prf_by_query", 1), ("ndcg10", 1), ("paired_diff", 1), ("report_cube", 1), ("bootstrap_ci", 1), ("phrase_slop0", 2), ("inverted_index", 1)])
def test_texts_are_cut_once(spark, name, most):
    """By the plan as it ran; a phrase is looked up in the texts that have its longest term, which are cut again."""
    import re

    import __spark_entry__ as entry

    made = entry.queries()[name](spark, "/root/testdata/sf0.001")
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    if name == "bootstrap_ci":  # the values are kept
        plan = plan.split("InMemoryRelation")[-1]
    spark.catalog.clearCache()
    assert 1 <= len(re.findall(r"\[doc_id(?:#\d+L?)?, transform\(|Filter \(size\(transform\(coalesce\(regexp_extract_all\(text", plan)) <= most
    assert "hashpartitioning(term#" not in plan or name != "inverted_index"


def test_found_terms_of_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (2, ["b"]), (None, ["a", "b"]), (3, [])], "k int, terms array<string>")
    query = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (8, "c"), (9, "z")], "q int, term string")
    of = retrieval.Found(docs, query, "k")
    assert sorted(map(str, (tuple(r) for r in of.all_terms().collect()))) == ["(7, 1)", "(7, None)", "(8, 2)"]
    assert sorted(map(str, (tuple(r) for r in of.counts().collect()))) == ["(7, 1, 3.0)", "(7, 2, 1.0)", "(7, None, 2.0)", "(8, 2, 1.0)"]
    score = {(r["q"], r["k"]): r["score"] for r in of.bm25().collect()}
    import math

    assert len(score) == 4 and math.isclose(score[8, 2], math.log(1 + 3.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 / 1.75)))


def test_texts_are_cut_once_for_each_mode(spark):
    import __spark_entry__ as entry

    made = entry.queries()["analyzer_pairs"](spark, "/root/testdata/sf0.001")
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ArrowEvalPython [apply(element_at(") == 3


def test_equal_words_are_spelled_once():
    import pyarrow as pa

    calls = []
    made = filters.once(pa.array(["a", "b", None, "a", ""] * 3), lambda different: calls.extend(different) or pa.array([w and w + w for w in different], pa.string()))
    assert made.to_pylist() == ["aa", "bb", None, "aa", ""] * 3 and sorted(filter(None, calls)) == ["a", "b"]


def test_found_terms_are_dealt_to_as_many_tasks_as_the_texts_need(spark):
    from lanna.plans.catalog import found, many

    data = "/root/testdata/sf0.001"
    assert found(spark, data).rows.rdd.getNumPartitions() == many(spark, data) >= 4


def test_token_lists_go_in_portions():
    import pyarrow as pa

    lists = pa.array([[1] * 1000] * 500 + [None, [], [2] * 200_000], pa.list_(pa.int32()))
    parts = list(filters.portions(lists))
    assert pa.concat_arrays(parts).equals(lists) and max(len(p.flatten()) for p in parts[:-1]) * filters.TOKEN_SIZE <= filters.AT_ONCE
