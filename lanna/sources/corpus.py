"""Annotated corpora as tables, and the sinks for postings and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.operators.filters import running


def tagged_words(text: Column) -> Column:
    """Words of a tab-separated article: an array of (sentence, word, pos, ne).

    A line with fewer than three fields, or without a word, ends a sentence; `_` is a space.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.split(line, "\t"))
    good = F.transform(lines, lambda x: ((F.size(x) >= 3) & (F.trim(F.get(x, F.lit(0))) != "")).cast("int"))
    # A sentence begins at each word line after another line, but for the first: lists of 1 there, and their running sums.
    begins = F.zip_with(good, F.concat(F.array(F.lit(0)), good), lambda now, before: F.when((now == 1) & (before == 0), 1).otherwise(0))
    rows = F.zip_with(lines, running("sum")(begins), lambda x, n: F.struct(x.alias("x"), n.alias("n")))
    rows = F.filter(rows, lambda r: (F.size(r["x"]) >= 3) & (F.trim(F.get(r["x"], F.lit(0))) != ""))
    word = lambda x: F.when(x[0] == "_", " ").otherwise(x[0])
    return F.transform(rows, lambda r: F.struct((r["n"] - 1).alias("sentence"), word(r["x"]).alias("word"), r["x"][1].alias("pos"), r["x"][2].alias("ne")))


def word_rows(articles: DataFrame, key: str, text: str) -> DataFrame:
    """A row a word: key, place in the article, sentence, word, pos, ne."""
    return articles.select(key, F.posexplode(tagged_words(F.col(text))).alias("place", "x")).select(key, "place", "x.*")


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """The articles of a folder, a file each: article (the file's name without its ending), place, sentence, word, pos, ne."""
    files = spark.read.text(path, wholetext=True).withColumn("article", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", ""))
    return word_rows(files, "article", "value")


def listed_words(words: DataFrame, key: str) -> DataFrame:
    """The words that are not blank: key, place, word, pos, ne."""
    return words.where(F.trim("word") != "").select(key, "place", "word", "pos", "ne")


def article_text(words: DataFrame, key: str) -> DataFrame:
    """The text of each article, a line a sentence; an article's words are gathered, as it is one text anyway."""
    sentences = words.groupBy(key, "sentence").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), "").alias("line"))
    return sentences.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence", "line"))), lambda x: x["line"]), "\n").alias("text"))


def write_postings(postings: DataFrame, path: str) -> None:
    """An index on disk: Parquet sorted by term within its files, so that a lookup of a term reads few row groups."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bulk_lines(docs: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """The bulk format of search engines: for each document a line with the action and one with the body, in one value."""
    action = F.to_json(F.struct(F.struct(F.lit(name).alias("_index"), F.col(key).cast("string").alias("_id")).alias("index")))
    return docs.select(F.concat_ws("\n", action, F.to_json(F.struct(F.col(text).alias("body")))).alias("value"))


def write_bulk(docs: DataFrame, key: str, text: str, name: str, path: str) -> None:
    bulk_lines(docs, key, text, name).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """Ranked results, a JSON object a row."""
    results.write.mode("overwrite").json(path)
