"""Queries of annotated corpora, sinks, analyzer pairs and the table function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanna.operators import analyzers, retrieval
from lanna.plans import expected
from lanna.plans.catalog import ORACLE_SQL, QUERIES, quoted, query, table, thai_texts
from lanna.sources import corpus

__all__ = ["ORACLE_SQL", "QUERIES"]

# -- annotated corpora ---------------------------------------------------------


def articles(spark, sf_dir):
    """An annotated article for each part: its name's words, a line too short, a space, its brand."""
    lines = F.concat(F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit("\tNN\tO"))), F.array(F.lit("too\tshort"), F.lit("_\tPU\tO"), F.concat("p_brand", F.lit("\tNN\tB_ORG"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(lines, "\n").alias("text"))


TAGGED_SQL = """SELECT p_partkey, CAST(i - 1 AS BIGINT) AS place, 0 AS sentence, w[i] AS word, 'NN' AS pos, 'O' AS ne FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))
    UNION ALL SELECT p_partkey, len(string_split(p_name, ' ')), 1, ' ', 'PU', 'O' FROM part UNION ALL SELECT p_partkey, len(string_split(p_name, ' ')) + 1, 1, p_brand, 'NN', 'B_ORG' FROM part"""


def words(spark, sf_dir):
    return corpus.word_rows(articles(spark, sf_dir), "p_partkey", "text").withColumn("place", F.col("place").cast("long"))


@query("tagged_words", TAGGED_SQL)
def tagged_words(spark, sf_dir):
    return words(spark, sf_dir)


@query("listed_words", f"SELECT p_partkey, place, word, pos, ne FROM ({TAGGED_SQL}) WHERE trim(word) <> ''")
def listed_words(spark, sf_dir):
    return corpus.listed_words(words(spark, sf_dir), "p_partkey")


@query("article_texts", "SELECT p_partkey, replace(p_name, ' ', '') || chr(10) || ' ' || p_brand AS text FROM part")
def article_texts(spark, sf_dir):
    return corpus.article_text(words(spark, sf_dir), "p_partkey")


# -- sinks -----------------------------------------------------------------------


@query("bulk_lines", """SELECT '{"index":{"_index":"customers","_id":"' || c_custkey || '"}}' || chr(10) || '{"body":"' || c_name || '"}' AS value FROM customer""")
def bulk_lines(spark, sf_dir):
    return corpus.bulk_lines(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "customers")


# -- analyzer pairs ----------------------------------------------------------------

#: Settings that are compared: modes of the index and of the search; and boosts of a plain field and one indexed with compounds.
PAIRS = (("none", "none"), ("mixed", "none"), ("mixed", "mixed"), ("discard", "discard"))
LAYERS = ((3.0, 1.0), (1.0, 1.0))


@query("analyzer_pairs", expected.values_sql(expected.PAIR_HITS, "config, q, n_texts", "SELECT config, q, CAST(sum(n) AS BIGINT) AS n FROM e JOIN (SELECT p_partkey % {texts} AS k, count(*) AS n FROM part GROUP BY 1) ON list_contains(n_texts, k) GROUP BY config, q"))
def analyzer_pairs(spark, sf_dir):
    """config, q, n: how many texts each search word finds, all its terms asked for, under each pair of modes and each layering."""
    asked = spark.createDataFrame([(w, w) for w in expected.ASKED], "q string, text string").coalesce(1)
    found, wanted = {}, {}
    modes = list(dict.fromkeys(m for pair in PAIRS for m in pair))
    for mode in modes:
        wanted[mode] = analyzers.analyzed(asked, "text", analyzers.analyzer(spark, mode)).select("q", F.explode("tokens.term").alias("term"))
    every = reduce(DataFrame.union, wanted.values())
    for mode in modes:
        texts = analyzers.analyzed(thai_texts(spark, sf_dir), "text", analyzers.analyzer(spark, mode)).select("p_partkey", F.col("tokens.term").alias("terms"))
        found[mode] = retrieval.Found(texts, every, "p_partkey")
    hits = {(a, b): found[a].all_terms(wanted[b]) for a, b in PAIRS}
    named = [(f"{a}/{b}", found) for (a, b), found in hits.items()]
    for main, sub in LAYERS:
        both = [(hits[pair].withColumn("score", F.lit(1.0)), boost) for pair, boost in ((("none", "none"), main), (("mixed", "none"), sub))]
        named.append((f"layered {main:g}:{sub:g}", retrieval.layered(both, "p_partkey")))
    whole = None
    for config, hit in named:
        n = hit.groupBy("q").agg(F.count("*").alias("n")).select(F.lit(config).alias("config"), "q", "n")
        whole = n if whole is None else whole.unionByName(n)
    return whole


# -- the table function ------------------------------------------------------------


@query("udtf_tokens", f"SELECT p_partkey, unnest(regexp_extract_all(p_name, {quoted(analyzers.WORD)})) AS term FROM part")
def udtf_tokens(spark, sf_dir):
    analyzers.register_udtf(spark)
    table(spark, sf_dir, "part").select("p_partkey", "p_name").createOrReplaceTempView("lanna_part")
    return spark.sql("SELECT p.p_partkey, t.term FROM lanna_part p, LATERAL thai_tokens(p.p_name, 'none') t")
