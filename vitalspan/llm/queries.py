"""Registered queries of the text operators and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.llm import (
    fill_in_middle, fingerprints, html_text, language, lexical_search, line_templates, mixing, near_dedup, packing, quality_classifier, quality_rules,
    repeated_passages, url_filter,
)
from vitalspan.llm.common import table
from vitalspan.session import configure


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole document, learned from three quarters of them."""
    docs = table(configure(spark), folder, "documents")
    found = language.identify(docs, language.train(docs.where(~language.held_out())))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = near_dedup.near_duplicates(table(configure(spark), folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document that recur as templates across documents."""
    found = line_templates.drop_recurring_lines(table(configure(spark), folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence and place of every token piece of every document."""
    return packing.pack_documents(table(configure(spark), folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that no recurring passage covers."""
    found = repeated_passages.remove_repeats(table(configure(spark), folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(table(configure(spark), folder, "pages"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_documents(table(configure(spark), folder, "documents"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL: the longest place rule, else pattern rules."""
    judged = url_filter.judge_urls(table(configure(spark), folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the balanced mix takes of every document."""
    mixed = mixing.mix_sources(table(configure(spark), folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document, the base test and the learned verdict."""
    spark = configure(spark)
    judged = quality_rules.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "rule")


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document rewritten, and the digest of the text got back."""
    found = fill_in_middle.fill_in_middle(table(configure(spark), folder, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from three quarters of the labels."""
    spark = configure(spark)
    docs = table(spark, folder, "documents")
    model = quality_classifier.train(docs.where(~language.held_out()), table(spark, folder, "labels"))
    return quality_classifier.score_documents(docs, model).select("doc_id", language.held_out().alias("held_out"), "score", "predicted")


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents of every benchmark item."""
    spark = configure(spark)
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_near_dedup, op3_line_dedup, op4_best_fit_packing, op5_substring_dedup, op6_html_extraction, op7_url_filter, op8_fingerprints, op9_source_mixing, op10_quality_rules,
        op11_fill_in_middle, op12_quality_classifier, op13_ranked_search)}


def _url_sql() -> str:
    """The URL verdicts in SQL, from the same rules."""
    up, low = url_filter.UPPER, url_filter.LOWER
    fits, verdicts = [], []
    for r in sorted(url_filter.PLACES, key=lambda r: (-len(r.name), r.name)):
        test = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        fits.append(f"WHEN {test} THEN '{r.name}'")
        verdicts.append(f"WHEN {test} THEN '{r.verdict}'")
    for r in url_filter.PATTERNS:
        verdicts.append(f"WHEN regexp_matches(low, '{r.regex}') THEN '{r.verdict}'")
    return f"""
WITH split AS (
  SELECT page_id, translate(coalesce(url, ''), '{up}', '{low}') AS low,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*', 0), '{up}', '{low}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split)
SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule,
       CASE {' '.join(verdicts)} ELSE 'allow' END AS verdict
FROM parts"""


_MIDDLE_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM base),
cut AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut"""

_SEARCH_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lexical_search.UPPER}', '{lexical_search.LOWER}'), '[^{lexical_search.BREAKS}]+') AS u FROM documents),
held AS (SELECT row_number() OVER () AS r, doc_id, u, len(u) AS n FROM d WHERE len(u) > 0),
size AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM held),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{lexical_search.UPPER}', '{lexical_search.LOWER}'), '[^{lexical_search.BREAKS}]+')) AS term
  FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(u) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
value AS (
  SELECT r, doc_id, term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // l))) AS v
  FROM tf JOIN df USING (term), size),
total AS (SELECT item_id, r, doc_id, CAST(sum(v) AS BIGINT) AS score FROM value JOIN wanted USING (term) GROUP BY ALL HAVING sum(v) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM total)
WHERE rank <= 50"""

ORACLE_SQL: dict[str, str] = {"op7_url_filter": _url_sql(), "op11_fill_in_middle": _MIDDLE_SQL, "op13_ranked_search": _SEARCH_SQL}
