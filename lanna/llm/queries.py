"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanna.llm.decontamination import op1_template_decontamination
from lanna.llm.language import op2_word_first_language
from lanna.llm.matroska import op4_matroska_media
from lanna.llm.minhash import op8_circulant_minhash
from lanna.llm.packing import op3_sum_of_squares_packing
from lanna.llm.pii import op10_weak_supervision
from lanna.llm.pseudo_likelihood import op5_masked_pseudo_likelihood
from lanna.llm.secrets import op6_secret_novelty
from lanna.llm.substrings import op9_window_dedup
from lanna.llm.token_files import op7_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_word_first_language": op2_word_first_language,
    "op3_sum_of_squares_packing": op3_sum_of_squares_packing,
    "op4_matroska_media": op4_matroska_media,
    "op5_masked_pseudo_likelihood": op5_masked_pseudo_likelihood,
    "op6_secret_novelty": op6_secret_novelty,
    "op7_token_files": op7_token_files,
    "op8_circulant_minhash": op8_circulant_minhash,
    "op9_window_dedup": op9_window_dedup,
    "op10_weak_supervision": op10_weak_supervision,
}

_WORDS = "[^\\x20\\x09-\\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Models, trained weights, compressed bytes, tokenizers and media files can't be written in SQL; those queries are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_circulant_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
    r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, reached FROM r JOIN links ON a = doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op9_window_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
    later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
    words AS (SELECT doc_id, ws[j] AS word, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
}
