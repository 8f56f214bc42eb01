"""What the contracts of some operators fix and SQL can tell: their base columns, by the operators themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrank.llm import fingerprints, licenses, quality
from quillrank.llm.shared import table


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the base verdict of the quality rules."""
    found = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, and places and labels of the base phrases."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each text and digest of its edited form."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, i FROM w, unnest(range(0, greatest(0, len(w) - {len(phrase.split()) - 1}))) t(i) WHERE w[i + 1:i + {len(phrase.split())}] = {phrase.split()!r}" for phrase, label in _PHRASES
)

SQL = {
    "base_quality": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM w, unnest(range(1, len(w) - 6)) t(i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) t(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN again USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
""",
    "base_licenses": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS ({_PLACES}),
g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM p GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
""",
    "edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS following, length(t) // 3 AS third FROM d)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - third) || left(following, third)) AS edited_sha256 FROM n
""",
}
