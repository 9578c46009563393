"""Queries over the sample tables, one or more for each operator, with the same in SQL for DuckDB."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanna.functions import scalar
from lanna.operators import analyzers, filters, retrieval
from lanna.operators.romanize import by_rules
from lanna.operators.segment import safe_cut
from lanna.plans import expected
from lanna.session import ship
from lanna.sources import dictionary

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores is dealt out to all of them before costly expressions: each part to as many, so that tasks don't grow with the table."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores * max(1, parts)) if parts < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, text."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def many(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the documents are dealt to by key: in proportion to the table, so that tasks don't grow with it."""
    return max(spark.sparkContext.defaultParallelism, 4 * table(spark, sf_dir, "documents").rdd.getNumPartitions())


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- text without Thai -------------------------------------------------------

TERMS_SQL = f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(analyzers.WORD)})) AS term FROM documents"
POSITIONS_SQL = f"""SELECT doc_id, lower(terms[i]) AS term, i - 1 AS position FROM (SELECT doc_id, terms, unnest(range(1, len(terms) + 1)) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, {quoted(analyzers.WORD)}) AS terms FROM documents))"""


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.terms(documents(spark, sf_dir), "doc_id", "text")


@query("token_topk", f"SELECT lower(term) AS term, count(*) AS n FROM ({TERMS_SQL}) GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def token_topk(spark, sf_dir):
    return document_terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)


PIECES_SQL = f"""SELECT doc_id, pieces[i] AS term, i FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, {quoted(analyzers.PIECE + "|[\\s\\S]")}) AS pieces FROM documents))"""


@query("token_offsets", f"""SELECT doc_id, position, term, tail - length(term) AS start, tail AS "end" FROM (
    SELECT doc_id, term, sum(length(term)) OVER w AS tail, sum(CASE WHEN regexp_full_match(term, '[ \\t\\r\\n]*') THEN 0 ELSE 1 END) OVER w - 1 AS position
    FROM ({PIECES_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE NOT regexp_full_match(term, '[ \\t\\r\\n]*')""")
def token_offsets(spark, sf_dir):
    return analyzers.native_token_rows(documents(spark, sf_dir), "doc_id", "text")


@query("token_type_counts", f"""SELECT CASE WHEN regexp_matches(term, '^[a-zA-Z]') THEN 'word' WHEN regexp_matches(term, '^[0-9]') THEN 'number' ELSE 'sign' END AS kind, count(*) AS n
    FROM ({TERMS_SQL}) GROUP BY 1""")
def token_type_counts(spark, sf_dir):
    kind = F.when(F.col("term").rlike("^[a-zA-Z]"), "word").when(F.col("term").rlike("^[0-9]"), "number").otherwise("sign")
    return document_terms(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# -- characters --------------------------------------------------------------

KEYS, THAI, BACK, LATIN = map(quoted, (scalar.KEYS, scalar.THAI_KEYS, scalar.BACK_THAI, scalar.BACK_KEYS))
AS_THAI_SQL = f"translate(lower(p_name), {KEYS}, {THAI})"


def thai_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names typed on the other layout: p_partkey, thai."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", scalar.to_kedmanee(F.lower("p_name")).alias("thai"))


@query("keyboard_to_thai", f"SELECT c_custkey, translate(c_name, {KEYS}, {THAI}) AS thai, regexp_matches(translate(c_name, {KEYS}, {THAI}), '[\\x{{0E00}}-\\x{{0E7F}}]') AS is_thai FROM customer")
def keyboard_to_thai(spark, sf_dir):
    thai = scalar.keyboard_text(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", thai.alias("thai"), scalar.contains_thai(thai).alias("is_thai"))


@query("keyboard_roundtrip", f"SELECT p_partkey, translate({AS_THAI_SQL}, {BACK}, {LATIN}) AS back FROM part")
def keyboard_roundtrip(spark, sf_dir):
    return thai_parts(spark, sf_dir).select("p_partkey", scalar.keyboard_text(F.col("thai"), "th_to_en").alias("back"))


@query("thai_digits", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS latin, true AS has_digit FROM orders")
def thai_digits(spark, sf_dir):
    thai = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "๐๑๒๓๔๕๖๗๘๙")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.thai_digits(thai).alias("latin"), scalar.contains_thai_digit(thai).alias("has_digit"))


def spelled(n):
    """Words of a number below ten million, as an array."""
    digits = ["", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า"]
    parts = []
    for power, word in ((1_000_000, "ล้าน"), (100_000, "แสน"), (10_000, "หมื่น"), (1_000, "พัน"), (100, "ร้อย"), (10, "สิบ"), (1, "")):
        d = (F.floor(n / power) % 10).cast("int")
        name = F.element_at(F.array(*map(F.lit, digits)), d + 1)
        if power == 10:
            name = F.when(d == 2, "ยี่").when(d == 1, "").otherwise(name)
        if power == 1:
            name = F.when((d == 1) & (F.floor(n / 10) > 0), "เอ็ด").otherwise(name)
        parts += [F.when(d > 0, name).otherwise(""), F.when(d > 0, word).otherwise("")]
    words = F.filter(F.array(*parts), lambda w: w != "")
    return F.when(n == 0, F.array(F.lit("ศูนย์"))).otherwise(words)


@query("number_words_parse", "SELECT o_orderkey, o_orderkey % 10000000 AS n, false AS other FROM orders")
def number_words_parse(spark, sf_dir):
    words = F.array_join(spelled(F.col("o_orderkey") % 10_000_000), "")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", scalar.parse_number_words(words).alias("n"), scalar.parse_number_words(F.concat(words, F.lit("อี้"))).isNotNull().alias("other"))


@query("number_sequence_merge", "SELECT c_custkey, CAST(c_custkey % 10000000 AS VARCHAR) AS number, 3 AS n_tokens FROM customer")
def number_sequence_merge(spark, sf_dir):
    ship(spark)
    words = F.concat(F.array(F.lit("ราคา")), spelled(F.col("c_custkey") % 10_000_000), F.array(F.lit("บาท")))
    spoken = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", words.alias("words"))
    placed = spoken.select("c_custkey", "words", filters.running("sum")(F.transform("words", F.length)).alias("ends"))
    tokens = F.zip_with("words", "ends", lambda w, end: F.struct(w.alias("term"), (end - F.length(w)).alias("start"), end.alias("end"), F.lit(1).alias("pos_inc"), F.lit(1).alias("pos_len"), F.lit("<THAI>").alias("type")))
    merged = filters.number(keep=False)(tokens)
    return placed.select("c_custkey", merged.alias("m")).select("c_custkey", F.col("m")[1]["term"].alias("number"), F.size("m").alias("n_tokens"))


STRIP_SQL = f"regexp_replace({AS_THAI_SQL}, '[\\x{{0E47}}-\\x{{0E4C}}\\x{{0E4E}}]', '', 'g')"


@query("tone_strip", f"SELECT p_partkey, {STRIP_SQL} AS plain, regexp_replace({AS_THAI_SQL}, '[\\x{{0E47}}-\\x{{0E4B}}]', '', 'g') AS tones_only FROM part")
def tone_strip(spark, sf_dir):
    return thai_parts(spark, sf_dir).select("p_partkey", scalar.strip_tones(F.col("thai")).alias("plain"), scalar.strip_tones(F.col("thai"), thanthakhat=False).alias("tones_only"))


def term_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names typed on the other layout, as tokens: p_partkey, tokens."""
    words = F.split("thai", " ")
    token = lambda w, k: F.struct(w.alias("term"), k.alias("start"), (k + 1).alias("end"), F.lit(1).alias("pos_inc"), F.lit(1).alias("pos_len"), F.lit("<THAI>").alias("type"))
    return thai_parts(spark, sf_dir).select("p_partkey", F.transform(words, token).alias("tokens"))


def flat(df: DataFrame, tokens) -> DataFrame:
    return df.select("p_partkey", F.posexplode(tokens).alias("n", "t")).select("p_partkey", "n", "t.term", "t.pos_inc", "t.type")


WORDS_SQL = f"SELECT p_partkey, unnest(string_split({AS_THAI_SQL}, ' ')) AS term, unnest(range(len(string_split({AS_THAI_SQL}, ' ')))) AS k FROM part"


def variants_sql(other: str, kind: str, when: str) -> str:
    return f"""SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY k, v) - 1 AS n, term, CASE v WHEN 0 THEN 1 ELSE 0 END AS pos_inc, CASE v WHEN 0 THEN '<THAI>' ELSE '{kind}' END AS type
    FROM (SELECT p_partkey, k, 0 AS v, term FROM ({WORDS_SQL}) UNION ALL SELECT p_partkey, k, 1, {other} FROM ({WORDS_SQL}) WHERE {when} AND {other} <> term AND {other} <> '')"""


IS_THAI_SQL = "regexp_matches(term, '[\\x{0E00}-\\x{0E7F}]')"
STRIP_TERM_SQL = "regexp_replace(term, '[\\x{0E47}-\\x{0E4C}\\x{0E4E}]', '', 'g')"


@query("tone_variants", variants_sql(STRIP_TERM_SQL, "<TONE_STRIPPED>", IS_THAI_SQL))
def tone_variants(spark, sf_dir):
    return flat(term_tokens(spark, sf_dir), filters.tone(F.col("tokens")))


@query("keyboard_variants", variants_sql(f"translate(term, {BACK}, {LATIN})", "<KEYBOARD_CORRECTED>", "length(term) >= 3"))
def keyboard_variants(spark, sf_dir):
    return flat(term_tokens(spark, sf_dir), filters.keyboard(F.col("tokens"), "kedmanee_to_qwerty", least=3))


def soundex_sql(text: str) -> str:
    s = text
    for pattern, to in scalar.SOUND_RULES:
        s = f"regexp_replace({s}, {quoted(pattern)}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    first, rest = (f"translate({x}, {quoted(a)}, {quoted(b)})" for x, a, b in (("s[1:1]", scalar.FIRST_FROM, scalar.FIRST_TO), ("s[2:]", scalar.NEXT_FROM, scalar.NEXT_TO)))
    return s, f"CASE WHEN s = '' THEN '' ELSE substring({first} || {rest} || '000000', 1, 7) END"


_CODED, _CODE = soundex_sql(AS_THAI_SQL)
CODES_SQL = f"SELECT p_partkey, {_CODE} AS code FROM (SELECT p_partkey, {_CODED} AS s FROM part)"


@query("soundex_codes", CODES_SQL)
def soundex_codes(spark, sf_dir):
    return thai_parts(spark, sf_dir).select("p_partkey", scalar.soundex(F.col("thai")).alias("code"))


@query("soundex_groups", f"SELECT code, count(*) AS n, min(p_partkey) AS first_key FROM ({CODES_SQL}) GROUP BY code")
def soundex_groups(spark, sf_dir):
    return soundex_codes(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@query("soundex_homophone_join", f"WITH c AS ({CODES_SQL}), g AS (SELECT code, min(p_partkey) AS leader FROM c GROUP BY code) SELECT p_partkey, leader FROM c JOIN g USING (code) WHERE p_partkey <> leader")
def soundex_homophone_join(spark, sf_dir):
    codes = soundex_codes(spark, sf_dir)
    leaders = codes.groupBy("code").agg(F.min("p_partkey").alias("leader"))
    return codes.join(leaders, "code").where("p_partkey <> leader").select("p_partkey", "leader")


_TERM_CODED, _TERM_CODE = soundex_sql("term")


@query("soundex_variants", f"""SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY k, v) - 1 AS n, term, CASE v WHEN 0 THEN 1 ELSE 0 END AS pos_inc, CASE v WHEN 0 THEN '<THAI>' ELSE '<PHONETIC>' END AS type
    FROM (SELECT p_partkey, k, 0 AS v, term FROM ({WORDS_SQL}) UNION ALL SELECT p_partkey, k, 1, code FROM (SELECT p_partkey, k, term, {_TERM_CODE} AS code FROM (SELECT p_partkey, k, term, {_TERM_CODED} AS s FROM ({WORDS_SQL})
    WHERE {IS_THAI_SQL} AND length(term) >= 3)) WHERE code <> '' AND code <> term)""")
def soundex_variants(spark, sf_dir):
    return flat(term_tokens(spark, sf_dir), filters.soundex(F.col("tokens")))


def weights_sql(chars: str) -> str:
    n = "unicode(c)"
    cases = [("ก", "ฯ", 0x010000), ("เ", "ไ", 0x030000), ("ะ", "ู", 0x020000), ("ๅ", "ๅ", 0x02000A), ("่", "๋", 0x040000), ("็", "๎", 0x050000), ("๐", "๙", 0x060000)]
    whens = " ".join(f"WHEN {n} BETWEEN {ord(a)} AND {ord(b)} THEN {base} + {n} - {ord(a)}" for a, b, base in cases)
    return f"array_to_string(list_transform(list_filter(string_split({chars}, ''), lambda c: c <> ''), lambda c: printf('%06x', CASE {whens} ELSE {0x100000} + {n} END)), '')"


MARK = "\\x{0E47}-\\x{0E4E}"
SWAPPED_SQL = f"regexp_replace({AS_THAI_SQL}, '([\\x{{0E40}}-\\x{{0E44}}])([\\x{{0E01}}-\\x{{0E2F}}])', '\\2\\1', 'g')"


def key_sql(strength: str) -> str:
    first = weights_sql(f"regexp_replace(s, '[{MARK}]', '', 'g')")
    if strength == "primary":
        return first
    marks = f"regexp_extract_all(s, '([^{MARK}])([{MARK}]*)', 2)"
    inner = weights_sql("m").replace("lambda c", "lambda c")
    each = "'000000'" if strength == "secondary" else f"{inner} || '000000'"
    return f"{first} || '000000' || array_to_string(list_transform({marks}, lambda m: {each}), '')"


@query("collation_keys", f"SELECT p_partkey, {key_sql('tertiary')} AS sort_key FROM (SELECT p_partkey, {SWAPPED_SQL} AS s FROM part)")
def collation_keys(spark, sf_dir):
    return thai_parts(spark, sf_dir).select("p_partkey", scalar.collation_key(F.col("thai")).alias("sort_key"))


@query("collation_strengths", f"SELECT p_partkey, {key_sql('primary')} AS first_level, {key_sql('secondary')} AS second_level FROM (SELECT p_partkey, {SWAPPED_SQL} AS s FROM part)")
def collation_strengths(spark, sf_dir):
    return thai_parts(spark, sf_dir).select("p_partkey", scalar.collation_key(F.col("thai"), "primary").alias("first_level"), scalar.collation_key(F.col("thai"), "secondary").alias("second_level"))


@query("collation_sort", f"SELECT p_partkey, row_number() OVER (ORDER BY k, p_partkey) AS place FROM (SELECT p_partkey, {key_sql('tertiary')} AS k FROM (SELECT p_partkey, {SWAPPED_SQL} AS s FROM part))")
def collation_sort(spark, sf_dir):
    return retrieval.placed(collation_keys(spark, sf_dir), "sort_key", "p_partkey").select("p_partkey", "place")


@query("collation_filter", f"""SELECT p_partkey, k AS n, sort_key AS term, 1 AS pos_inc, '<THAI>' AS type FROM (SELECT p_partkey, k, {key_sql('tertiary')} AS sort_key
    FROM (SELECT p_partkey, k, regexp_replace(term, '([\\x{{0E40}}-\\x{{0E44}}])([\\x{{0E01}}-\\x{{0E2F}}])', '\\2\\1', 'g') AS s FROM ({WORDS_SQL})))""")
def collation_filter(spark, sf_dir):
    return flat(term_tokens(spark, sf_dir), filters.collation(F.col("tokens")))


# -- tables of words ---------------------------------------------------------


def values(rows: list[tuple]) -> str:
    show = lambda x: quoted(x) if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


EXACT, DOTLESS, REVERSE = filters.short_forms()
SHORT = sorted(EXACT)
FULL = sorted(REVERSE)


def picked(spark: SparkSession, sf_dir: str, words: list[str], key: str = "o_orderkey") -> DataFrame:
    """Orders with the word that their key picks: key, tokens of one term."""
    term = F.element_at(F.array(*map(F.lit, words)), (F.col(key) % len(words) + 1).cast("int"))
    token = F.struct(term.alias("term"), F.lit(0).alias("start"), F.length(term).alias("end"), F.lit(1).alias("pos_inc"), F.lit(1).alias("pos_len"), F.lit("<THAI>").alias("type"))
    return spread(table(spark, sf_dir, "orders").select(key)).select(key, F.array(token).alias("tokens"))


def expansion_sql(words: list[str], table_: dict[str, str], look: str) -> str:
    return f"""WITH w(k, term) AS ({values([*enumerate(words)])}), m(term, other) AS ({values(sorted(table_.items()))})
    SELECT o_orderkey, w.term AS term, m.other AS other FROM orders JOIN w ON o_orderkey % {len(words)} = w.k LEFT JOIN m ON {look} = m.term"""


def expansions(df: DataFrame, tokens) -> DataFrame:
    return df.select("o_orderkey", "tokens", tokens.alias("t")).select("o_orderkey", F.col("tokens")[0]["term"].alias("term"), F.get("t", F.lit(1))["term"].alias("other"))


@query("acronym_expand", expansion_sql(SHORT, EXACT, "w.term"))
def acronym_expand(spark, sf_dir):
    return expansions(picked(spark, sf_dir, SHORT), filters.acronym(F.col("tokens"), normalize_dots=False))


@query("acronym_dotless", expansion_sql(sorted(DOTLESS), DOTLESS, "w.term"))
def acronym_dotless(spark, sf_dir):
    return expansions(picked(spark, sf_dir, sorted(DOTLESS)), filters.acronym(F.col("tokens")))


@query("acronym_reverse", expansion_sql(FULL, REVERSE, "w.term"))
def acronym_reverse(spark, sf_dir):
    return expansions(picked(spark, sf_dir, FULL), filters.acronym(F.col("tokens"), both_ways=True, normalize_dots=False))


ROMAN = sorted((w, list(s)) for w, s in dictionary.romanization_rows())


@query("romanize_dictionary", f"""WITH w(k, term) AS ({values([(k, w) for k, (w, _) in enumerate(ROMAN)])}), m(term, latin) AS ({values([(w, x) for w, s in ROMAN for x in s])})
    SELECT o_orderkey, m.latin AS latin FROM orders JOIN w ON o_orderkey % {len(ROMAN)} = w.k JOIN m ON w.term = m.term""")
def romanize_dictionary(spark, sf_dir):
    """The table's entries as the filter spells them."""
    ship(spark)
    found = picked(spark, sf_dir, [w for w, _ in ROMAN]).select("o_orderkey", F.explode(filters.romanization()(F.col("tokens"))).alias("t"))
    return found.where(F.col("t.type") == "<ROMANIZATION>").select("o_orderkey", F.col("t.term").alias("latin"))


STOPS = ["the", "of", "and", "to", "in", "de", "la", "und", "der", "."]


@query("stopword_filter", f"WITH t AS ({POSITIONS_SQL}), s(term) AS ({values([(w,) for w in STOPS])}) SELECT term, count(*) AS n, sum(position) AS positions FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.term = t.term) GROUP BY term")
def stopword_filter(spark, sf_dir):
    """Terms that the filter keeps, at the positions they had."""
    ship(spark)
    how = lambda text: filters.stop(filters.lowercase(analyzers.segmenter(spark)(text)), STOPS)
    rows = analyzers.rows(analyzers.analyzed(documents(spark, sf_dir), "text", how), "doc_id")
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.sum("position").alias("positions"))


LATIN_WORDS = ["steel", "red", "blue", "small", "large", "tin", "copper", "a", "an", "in", "ed", "ble", "part", "pa"]


@query("dictionary_prefix_matches", f"""WITH w(word) AS ({values([(w,) for w in LATIN_WORDS])}) SELECT p_partkey, i AS start, w.word AS word
    FROM (SELECT p_partkey, lower(p_name) AS t, unnest(range(1, length(p_name) + 1)) AS i FROM part) JOIN w ON substring(t, i, length(w.word)) = w.word""")
def dictionary_prefix_matches(spark, sf_dir):
    words = F.broadcast(spark.createDataFrame([(w,) for w in LATIN_WORDS], "word string"))
    starts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", F.lower("p_name").alias("t")).select("p_partkey", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("start"))
    lengths = sorted({len(w) for w in LATIN_WORDS})
    pieces = starts.select("p_partkey", F.col("start").cast("long").alias("start"), "t", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.col("start") + F.col("n") - 1 <= F.length("t"))
    return pieces.select("p_partkey", "start", F.substr("t", F.col("start").cast("int"), "n").alias("word")).join(words, "word").select("p_partkey", "start", "word")


@query("dictionary_statistics", f"WITH w(word, weight) AS ({values([(w, float(k % 3 + 1)) for k, w in enumerate(LATIN_WORDS)])}) SELECT count(*) AS words, sum(weight) AS total, max(weight) AS heaviest, max(length(word)) AS longest FROM w")
def dictionary_statistics(spark, sf_dir):
    lexicon = dictionary.Lexicon({w: float(k % 3 + 1) for k, w in enumerate(LATIN_WORDS)})
    return dictionary.lexicon_frame(spark, lexicon).agg(F.count("*").alias("words"), F.sum("weight").alias("total"), F.max("weight").alias("heaviest"), F.max(F.length("word")).alias("longest"))


@query("dictionary_base_variant", "SELECT DISTINCT p_name AS word FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 25)")
def dictionary_base_variant(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return dictionary.base_variant(part.select(F.col("p_name").alias("word")).distinct(), part.where("p_size > 25").select(F.col("p_name").alias("word")))


# -- retrieval ---------------------------------------------------------------

QUERY_SQL = f"""SELECT q, terms[i] AS term, i - 1 AS place FROM (SELECT q, terms, unnest(range(1, len(terms) + 1)) AS i FROM (
    SELECT item_id AS q, list_filter(list_transform(regexp_extract_all(text, {quoted(analyzers.WORD)}), lambda t: lower(t)), lambda t: length(t) >= 5) AS terms FROM benchmark))"""
POSTINGS_SQL = f"SELECT term, doc_id, count(*) AS tf FROM ({POSITIONS_SQL}) GROUP BY term, doc_id"


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of five or more letters of every benchmark item: q, term, place."""
    long = F.filter(F.transform(analyzers.native_terms(F.col("text")), F.lower), lambda t: F.length(t) >= 5)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.posexplode(long).alias("place", "term"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, not their terms, are brought to the tasks that index them."""
    dealt = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(many(spark, sf_dir), "doc_id")
    return retrieval.index(retrieval.terms(dealt, "doc_id", "text"), "doc_id")


@query("inverted_index", f"SELECT term, doc_id, count(*) AS tf, min(position) AS first_position, max(position) AS last_position FROM ({POSITIONS_SQL}) GROUP BY term, doc_id")
def inverted_index(spark, sf_dir):
    return postings(spark, sf_dir).select("term", "doc_id", "tf", F.element_at("positions", 1).cast("long").alias("first_position"), F.element_at("positions", -1).cast("long").alias("last_position"))


@query("term_df", f"SELECT term, count(*) AS df FROM ({POSTINGS_SQL}) GROUP BY term")
def term_df(spark, sf_dir):
    return retrieval.document_frequencies(postings(spark, sf_dir))


@query("df_band_filter", f"SELECT term, count(*) AS df FROM ({POSTINGS_SQL}) WHERE length(term) >= 3 GROUP BY term HAVING count(*) BETWEEN 2 AND 40")
def df_band_filter(spark, sf_dir):
    return term_df(spark, sf_dir).where("length(term) >= 3 and df between 2 and 40")


@query("match_or", f"SELECT DISTINCT q, doc_id FROM ({QUERY_SQL}) JOIN ({POSTINGS_SQL}) USING (term)")
def match_or(spark, sf_dir):
    query = search_terms(spark, sf_dir)
    return retrieval.match_any(retrieval.sought(document_terms(spark, sf_dir), query), query, "doc_id")


MATCH_ALL_SQL = f"SELECT q, doc_id FROM (SELECT DISTINCT q, term FROM ({QUERY_SQL})) JOIN ({POSTINGS_SQL}) USING (term) JOIN (SELECT q, count(DISTINCT term) AS n FROM ({QUERY_SQL}) GROUP BY q) USING (q) GROUP BY q, doc_id, n HAVING count(*) = n"


@query("match_and", MATCH_ALL_SQL)
def match_and(spark, sf_dir):
    query = search_terms(spark, sf_dir)
    return retrieval.match_all(retrieval.sought(document_terms(spark, sf_dir), query).select("term", "doc_id").distinct(), query, "doc_id")


PHRASE_TERMS_SQL = f"""SELECT q, terms[i] AS term, i - 1 AS place FROM (SELECT q, terms, unnest(range(1, len(terms) + 1)) AS i FROM (
    SELECT item_id AS q, list_transform(regexp_extract_all(text, {quoted(analyzers.WORD)}), lambda t: lower(t)) AS terms FROM benchmark))"""


@query("phrase_slop0", f"""WITH q AS ({PHRASE_TERMS_SQL}), s AS (SELECT q, count(*) AS n FROM q GROUP BY q), t AS ({POSITIONS_SQL})
    SELECT DISTINCT q, doc_id FROM (SELECT q, doc_id, position - place AS b, count(*) AS found FROM q JOIN t USING (term) GROUP BY 1, 2, 3) JOIN s USING (q) WHERE found = n""")
def phrase_slop0(spark, sf_dir):
    wanted = retrieval.terms(table(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("item_id").alias("q"), F.col("position").alias("place"), "term")
    return retrieval.phrase(document_terms(spark, sf_dir), wanted, "doc_id", lambda keys: retrieval.terms(documents(spark, sf_dir).join(keys, "doc_id", "left_semi"), "doc_id", "text"))


SCORES_SQL = f"""SELECT q, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
    FROM (SELECT DISTINCT q, term FROM ({QUERY_SQL})) JOIN ({POSTINGS_SQL}) p USING (term) JOIN (SELECT term, count(*) AS df FROM ({POSTINGS_SQL}) GROUP BY term) USING (term)
    JOIN (SELECT doc_id, sum(tf) AS length FROM ({POSTINGS_SQL}) GROUP BY doc_id) USING (doc_id)
    CROSS JOIN (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT doc_id, sum(tf) AS length FROM ({POSTINGS_SQL}) GROUP BY doc_id)) GROUP BY q, doc_id"""


def ranked_sql(scores: str, most: int) -> str:
    return f"SELECT q, doc_id, score, rank FROM (SELECT q, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 4) DESC, doc_id) AS rank FROM ({scores})) WHERE rank <= {most}"


def found(spark: SparkSession, sf_dir: str) -> retrieval.Found:
    return retrieval.Found(retrieval.term_lists(documents(spark, sf_dir), "doc_id", "text"), search_terms(spark, sf_dir), "doc_id", many(spark, sf_dir))


@query("bm25_top10", ranked_sql(SCORES_SQL, 10))
def bm25_top10(spark, sf_dir):
    return retrieval.ranked(found(spark, sf_dir).bm25(), "doc_id", 10).select("q", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


TF_SQL = f"SELECT q, doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM (SELECT DISTINCT q, term FROM ({QUERY_SQL})) JOIN ({POSTINGS_SQL}) USING (term) GROUP BY q, doc_id"


@query("layered_should", ranked_sql(f"SELECT q, doc_id, sum(score) AS score FROM (SELECT q, doc_id, 3 * score AS score FROM ({TF_SQL}) UNION ALL SELECT q, doc_id, 1.0 FROM ({MATCH_ALL_SQL})) GROUP BY q, doc_id", 10))
def layered_should(spark, sf_dir):
    of = found(spark, sf_dir)
    whole = retrieval.layered([(of.counts(), 3.0), (of.all_terms().withColumn("score", F.lit(1.0)), 1.0)], "doc_id")
    return retrieval.ranked(whole, "doc_id", 10).select("q", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("lenient_relevance", f"SELECT DISTINCT term, doc_id FROM (SELECT DISTINCT term FROM ({QUERY_SQL})) JOIN documents ON contains(lower(text), term)")
def lenient_relevance(spark, sf_dir):
    """Of every search term the documents that hold it, also inside words."""
    return retrieval.containing(documents(spark, sf_dir), search_terms(spark, sf_dir), "doc_id", "text")


GOLD_SQL = MATCH_ALL_SQL


@query("prf_by_query", f"""WITH h AS ({GOLD_SQL}), r AS (SELECT DISTINCT q, doc_id FROM ({ranked_sql(SCORES_SQL, 1000)})), f AS (SELECT r.q, count(*) AS n, count(h.q) AS good FROM r LEFT JOIN h ON r.q = h.q AND r.doc_id = h.doc_id GROUP BY r.q),
    b AS (SELECT g.q, g.total, coalesce(f.n, 0) AS n, coalesce(f.good, 0) AS good FROM (SELECT q, count(*) AS total FROM h GROUP BY q) g LEFT JOIN f ON g.q = f.q), x AS (SELECT q, n, CASE WHEN n > 0 THEN good / n ELSE 0.0 END AS p, good / total AS r FROM b)
    SELECT q, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, n = 0 AS zero FROM x""")
def prf_by_query(spark, sf_dir):
    of = found(spark, sf_dir)
    return retrieval.precision_recall(retrieval.ranked(of.bm25(), "doc_id", 1000), of.all_terms(), "doc_id")


def ndcg_sql(ranked: str) -> str:
    return f"""SELECT q, round(coalesce(gain, 0) / ideal, 6) AS ndcg FROM (SELECT q, (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) t(k) WHERE k <= n) AS ideal FROM (SELECT q, count(*) AS n FROM ({GOLD_SQL}) GROUP BY q))
    LEFT JOIN (SELECT q, sum(1 / log2(rank + 1)) AS gain FROM ({ranked}) JOIN ({GOLD_SQL}) USING (q, doc_id) GROUP BY q) USING (q)"""


def ndcgs(of: retrieval.Found, scores: DataFrame) -> DataFrame:
    return retrieval.ndcg(retrieval.ranked(scores, "doc_id", 10), of.all_terms(), "doc_id")


@query("ndcg10", ndcg_sql(ranked_sql(SCORES_SQL, 10)))
def ndcg10(spark, sf_dir):
    of = found(spark, sf_dir)
    return ndcgs(of, of.bm25())


PAIRED_SQL = f"SELECT q, a.ndcg AS bm25, b.ndcg AS tf, round(a.ndcg - b.ndcg, 6) AS difference FROM ({ndcg_sql(ranked_sql(SCORES_SQL, 10))}) a JOIN ({ndcg_sql(ranked_sql(TF_SQL, 10))}) b USING (q)"


@query("paired_diff", PAIRED_SQL)
def paired_diff(spark, sf_dir):
    of = found(spark, sf_dir)
    a, b = ndcgs(of, of.bm25()).withColumnRenamed("ndcg", "bm25"), ndcgs(of, of.counts()).withColumnRenamed("ndcg", "tf")
    return a.join(b, "q").select("q", "bm25", "tf", F.round(F.col("bm25") - F.col("tf"), 6).alias("difference"))


@query("bootstrap_ci", f"""WITH v AS (SELECT row_number() OVER (ORDER BY q) - 1 AS k, CAST(round(ndcg * 1000000) AS BIGINT) AS value FROM ({ndcg_sql(ranked_sql(SCORES_SQL, 10))})), s AS (SELECT count(*) AS n, sum(value) AS whole FROM v),
    d AS (SELECT r, (r * 7919 + k * 104729 + (r * k % 1009) * 31) % n AS k FROM v CROSS JOIN s CROSS JOIN range(0, 4000) t(r)), m AS (SELECT r, sum(value) AS total, row_number() OVER (ORDER BY sum(value), r) - 1 AS place FROM d JOIN v USING (k) GROUP BY r)
    SELECT round(max(CASE WHEN place = 100 THEN total END) / max(n), 4) AS low, round(max(CASE WHEN place = 3900 THEN total END) / max(n), 4) AS high, round(max(whole) / max(n), 4) AS mean FROM m CROSS JOIN s""")
def bootstrap_ci(spark, sf_dir):
    return retrieval.bootstrap(ndcg10(spark, sf_dir).select("q", F.round(F.col("ndcg") * 1_000_000).alias("value")))


@query("report_cube", f"""SELECT config, even, count(*) AS n, round(avg(ndcg), 4) AS mean FROM (SELECT 'bm25' AS config, q % 2 = 0 AS even, ndcg FROM ({ndcg_sql(ranked_sql(SCORES_SQL, 10))}) UNION ALL
    SELECT 'tf', q % 2 = 0, ndcg FROM ({ndcg_sql(ranked_sql(TF_SQL, 10))})) GROUP BY CUBE (config, even)""")
def report_cube(spark, sf_dir):
    of = found(spark, sf_dir)
    both = [ndcgs(of, scores).select(F.lit(name).alias("config"), (F.col("q") % 2 == 0).alias("even"), "ndcg") for name, scores in (("bm25", of.bm25()), ("tf", of.counts()))]
    return both[0].unionByName(both[1]).cube("config", "even").agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 4).alias("mean"))


TAGS_SQL = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS place, (l_partkey // 50) % 2 AS sentence, l_linestatus || l_linenumber AS word,
    CASE l_partkey % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B_' || l_returnflag WHEN 2 THEN 'B_' || l_returnflag WHEN 3 THEN 'I_' || l_returnflag ELSE 'E_' || l_returnflag END AS ne FROM lineitem"""


@query("bio_entities", f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, sentence ORDER BY place) AS r FROM ({TAGS_SQL}))
    SELECT b.l_orderkey, substring(b.ne, 3) AS name, string_agg(w.word, '' ORDER BY w.place) AS text FROM w b JOIN w ON w.l_orderkey = b.l_orderkey AND w.sentence = b.sentence AND w.r >= b.r WHERE b.ne LIKE 'B#_%' ESCAPE '#'
    AND NOT EXISTS (SELECT 1 FROM w x WHERE x.l_orderkey = b.l_orderkey AND x.sentence = b.sentence AND x.r > b.r AND x.r <= w.r AND x.ne NOT IN ('I_' || substring(b.ne, 3), 'E_' || substring(b.ne, 3)))
    AND NOT EXISTS (SELECT 1 FROM w x WHERE x.l_orderkey = b.l_orderkey AND x.sentence = b.sentence AND x.r > b.r AND x.r < w.r AND x.ne = 'E_' || substring(b.ne, 3)) GROUP BY b.l_orderkey, b.sentence, b.r, b.ne""")
def bio_entities(spark, sf_dir):
    """Tags of order lines, in two sentences an order, picked by the parts' keys: all kinds, some that nothing began."""
    tag = F.element_at(F.array(F.lit("O"), *[F.concat(F.lit(x), "l_returnflag") for x in ("B_", "B_", "I_", "E_")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    place = F.col("l_linenumber") * F.lit(1_000_000_000_000).cast("long") + F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("place"), (F.floor(F.col("l_partkey") / 50) % 2).alias("sentence"), tag.alias("ne"), F.concat("l_linestatus", "l_linenumber").alias("word"))
    return retrieval.entities(words, "l_orderkey", "place", "sentence")


@query("sampled_queries", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS r FROM part) WHERE r <= 15")
def sampled_queries(spark, sf_dir):
    return retrieval.sampled(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 15).select("p_brand", "p_partkey")


@query("segmentation_f1", f"""WITH a AS (SELECT doc_id, tail - length(term) AS b, tail FROM (SELECT doc_id, term, sum(length(term)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS tail FROM ({PIECES_SQL})) WHERE NOT regexp_full_match(term, '[ \\t\\r\\n]*')),
    w AS (SELECT doc_id, p[i] AS term, i FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[ \\t\\r\\n]+|[^ \\t\\r\\n]+') AS p FROM documents))),
    c AS (SELECT doc_id, tail - length(term) AS b, tail FROM (SELECT doc_id, term, sum(length(term)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS tail FROM w) WHERE NOT regexp_full_match(term, '[ \\t\\r\\n]*')),
    s AS (SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM c) AS m, (SELECT count(*) FROM a JOIN c USING (doc_id, b, tail)) AS hits) SELECT round(hits / n, 6) AS precision, round(hits / m, 6) AS recall, round(2 * (hits / n) * (hits / m) / (hits / n + hits / m), 6) AS f1 FROM s""")
def segmentation_f1(spark, sf_dir):
    """The segmenter's spans against the runs between blanks, whose lengths are those of blanks if below 0."""
    ours = F.transform(analyzers.segmenter(spark)(F.col("text")), lambda t: retrieval.span(t["start"], t["end"]))
    lengths = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[ \t\r\n]+|[^ \t\r\n]+"), F.lit(0)), lambda x: F.when(F.substring(x, 1, 1).isin(*" \t\r\n"), -F.length(x)).otherwise(F.length(x)))
    cut = documents(spark, sf_dir).select(ours.alias("ours"), lengths.alias("n")).select("ours", "n", filters.running("sum")(F.transform("n", F.abs)).alias("ends"))
    runs = F.filter(F.zip_with("n", "ends", lambda n, end: F.when(n > 0, retrieval.span(end - n, end))), lambda x: x.isNotNull())
    return retrieval.span_f1(cut.select("ours", runs.alias("runs")), "ours", "runs")


# -- Thai text: the expected rows are written down in expected.py ------------------


def thai_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thai sentences picked by the keys of all parts: p_partkey, text."""
    term = F.element_at(F.array(*map(F.lit, expected.TEXTS)), (F.col("p_partkey") % len(expected.TEXTS) + 1).cast("int"))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", term.alias("text"))


def written_sql(rows: list[tuple], columns: str) -> str:
    """Every part with the rows that are written down for its text; the first field of a row is the text's number."""
    return f"WITH e(k, {columns}) AS ({values(rows)}) SELECT p_partkey, {columns} FROM part JOIN e ON p_partkey % {len(expected.TEXTS)} = e.k"


TOKEN_COLUMNS = 'position, term, start, "end", pos_inc, pos_len, type'


@query("segment_words", written_sql(expected.tokens(expected.WORDS), TOKEN_COLUMNS))
def segment_words(spark, sf_dir):
    return analyzers.rows(analyzers.analyzed(thai_texts(spark, sf_dir), "text", analyzers.analyzer(spark)), "p_partkey")


@query("mixed_graph_positions", written_sql(expected.tokens(expected.MIXED), TOKEN_COLUMNS))
def mixed_graph_positions(spark, sf_dir):
    return analyzers.rows(analyzers.analyzed(thai_texts(spark, sf_dir), "text", analyzers.segmenter(spark, "mixed")), "p_partkey")


@query("person_analyzer", written_sql(expected.tokens(expected.PERSON), TOKEN_COLUMNS))
def person_analyzer(spark, sf_dir):
    return analyzers.rows(analyzers.analyzed(thai_texts(spark, sf_dir), "text", analyzers.person_analyzer(spark)), "p_partkey")


@query("custom_chain", written_sql(expected.tokens(expected.CUSTOM), TOKEN_COLUMNS))
def custom_chain(spark, sf_dir):
    how = analyzers.custom(spark, ["lowercase", "thai_number", "thai_acronym", "thai_romanization"])
    return analyzers.rows(analyzers.analyzed(thai_texts(spark, sf_dir), "text", how), "p_partkey")


@query("normalize_forms", written_sql(expected.NORMAL, "normal"))
def normalize_forms(spark, sf_dir):
    return thai_texts(spark, sf_dir).select("p_partkey", analyzers.keyword(spark)(F.col("text")).alias("normal"))


@query("rtgs_algorithmic", written_sql(expected.LATIN, "word, latin"))
def rtgs_algorithmic(spark, sf_dir):
    """The rules' spelling of every word of the texts."""
    ship(spark)

    @F.arrow_udf("string")
    def spell(words: pa.Array) -> pa.Array:
        return filters.once(words, lambda different: pa.array([w and by_rules(w) for w in different], pa.string()))

    words = analyzers.analyzed(thai_texts(spark, sf_dir), "text", analyzers.segmenter(spark)).select("p_partkey", F.explode("tokens").alias("t"))
    words = words.where(scalar.contains_thai(F.col("t.term"))).select("p_partkey", F.col("t.term").alias("word")).distinct()
    return words.select("p_partkey", "word", spell("word").alias("latin"))


@query("safe_cuts", written_sql(expected.CUTS, "cut"))
def safe_cuts(spark, sf_dir):
    ship(spark)

    @F.pandas_udf("int")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: safe_cut(t, 1, len(t)))

    return thai_texts(spark, sf_dir).select("p_partkey", cut("text").alias("cut"))


@query("final_offsets", "SELECT doc_id, length(text) AS final_offset FROM documents")
def final_offsets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", analyzers.final_offsets(F.col("text")).alias("final_offset"))


@query("mixed_phrases", written_sql(expected.PHRASES, "phrase"))
def mixed_phrases(spark, sf_dir):
    """Which texts, indexed with compounds and their parts, hold which phrases; a phrase's terms are parted by blanks."""
    rows = lambda texts: analyzers.rows(analyzers.analyzed(texts, "text", analyzers.analyzer(spark, "mixed")), "p_partkey")
    texts = thai_texts(spark, sf_dir)
    query = spark.createDataFrame([(p, k, w) for p in expected.SOUGHT for k, w in enumerate(p.split(" "))], "q string, place int, term string")
    found = retrieval.phrase(rows(texts), query, "p_partkey", lambda keys: rows(texts.join(keys, "p_partkey", "left_semi")))
    return found.select("p_partkey", F.col("q").alias("phrase"))


@query("documents_by_segmenter", f"SELECT lower(term) AS term, count(*) AS n FROM ({TERMS_SQL}) GROUP BY 1")
def documents_by_segmenter(spark, sf_dir):
    """Terms of all documents, those with Thai letters cut by the segmenter, the others by the native expression."""
    terms = documents(spark, sf_dir).select(F.explode(analyzers.all_terms(spark, F.col("text"))).alias("term"))
    return terms.groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("n"))


@query("documents_by_python", f"SELECT doc_id, len(regexp_extract_all(text, {quoted(analyzers.WORD)})) AS n FROM documents")
def documents_by_python(spark, sf_dir):
    """The segmenter itself over all documents; it must agree with the native expression."""
    return documents(spark, sf_dir).select("doc_id", F.size(analyzers.segmenter(spark)(F.col("text"))).cast("long").alias("n"))


@query("streamed_terms", f"SELECT lower(term) AS term, count(*) AS n FROM ({TERMS_SQL}) GROUP BY 1")
def streamed_terms(spark, sf_dir):
    """All documents as a stream of files; the result of a run to the end equals the batch."""
    from lanna.streaming.analysis import counted_stream

    return counted_stream(spark, f"{sf_dir}/documents.parquet")
