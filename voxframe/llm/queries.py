"""Queries of the text operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import bpe_chunks, decontaminate, html_text, jaccard_join, kneser_ney, line_dedup, mpeg_audio, pii, quotes, token_files
from voxframe.llm.common import staged, table, tuned


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return kneser_ney.classify(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(tuned(spark), sf_dir, "pages"))


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in reply order, without quotes."""
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity classes of all documents."""
    return jaccard_join.join_similar(table(tuned(spark), sf_dir, "documents"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an audio file, stored in the shared folder and read back from there."""
    files = staged(mpeg_audio.to_audio(table(tuned(spark), sf_dir, "documents")), "audio")
    return mpeg_audio.described(files)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_personal(table(tuned(spark), sf_dir, "documents"))


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    return bpe_chunks.round_trip(table(tuned(spark), sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items."""
    return decontaminate.find_leaks(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids to ORC and describes the files."""
    return token_files.written_and_read(table(tuned(spark), sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops repeated lines over all documents."""
    return line_dedup.report(table(tuned(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_html_text": op2_html_text,
    "op3_quotes": op3_quotes,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mpeg_audio": op5_mpeg_audio,
    "op6_pii": op6_pii,
    "op7_bpe_chunks": op7_bpe_chunks,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_orc": op9_token_orc,
    "op10_line_dedup": op10_line_dedup,
}

_LINES = r"""
WITH lines AS (
  SELECT doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \t\n\x0b\x0c\r') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT l.doc_id, l.i, l.line, o.owner IS NOT NULL AND o.owner < l.doc_id AS gone FROM lines l LEFT JOIN owners o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_REPLIES = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), split AS (
  SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m
), lines AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^(?:[ \t]*>)+', '') AS body FROM split
), own AS (
  SELECT m.r, m.conv_id, m.turn, m.role,
    CASE WHEN bool_or(level > 0) THEN trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT regexp_matches(body, '(?i)^\s*on\s.{1,200}\swrote:\s*$')), ''), E' \n\t\r') ELSE any_value(m.text) END AS reply
  FROM m JOIN lines l ON l.r = m.r GROUP BY ALL
), runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY r, level ORDER BY i) AS run FROM lines
), passages AS (
  SELECT r, conv_id, turn, level, run, string_agg(body, chr(10) ORDER BY i) AS body FROM runs WHERE level > 0 GROUP BY ALL
), asked AS (
  SELECT r, conv_id, turn, level, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM (SELECT r, conv_id, turn, level, body FROM passages UNION ALL SELECT r, conv_id, turn, level, body FROM lines WHERE level > 0)
), said AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM (SELECT conv_id, turn, body FROM lines WHERE level = 0 UNION ALL SELECT conv_id, turn, reply FROM own)
), origin AS (
  SELECT conv_id, words, min(turn) AS origin FROM said WHERE length(words) > 0 GROUP BY ALL
), best AS (
  SELECT a.r, a.conv_id, a.turn, arg_max(o.origin, (-a.level, length(a.words), o.origin)) AS parent
  FROM asked a JOIN origin o ON a.conv_id = o.conv_id AND a.words = o.words AND o.origin < a.turn GROUP BY ALL
), up AS (SELECT conv_id, turn, min(parent) AS parent FROM best GROUP BY ALL
), way AS (
  SELECT conv_id, turn, parent, [parent, turn] AS path FROM up
  UNION ALL SELECT w.conv_id, w.turn, u.parent, list_prepend(u.parent, w.path) FROM way w JOIN up u ON u.conv_id = w.conv_id AND u.turn = w.parent
), path AS (SELECT conv_id, turn, arg_max(path, len(path)) AS path FROM way GROUP BY ALL
), place AS (SELECT *, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) AS position FROM path
), n AS (SELECT r, count(*) AS n FROM passages GROUP BY r)
SELECT own.conv_id, own.turn, own.role, best.parent AS parent_turn,
  CASE WHEN best.parent IS NULL THEN own.turn ELSE place.path[1] END AS root_turn,
  CASE WHEN best.parent IS NULL THEN 0 ELSE len(place.path) - 1 END AS depth,
  CASE WHEN best.parent IS NULL THEN 0 ELSE place.position END AS position,
  coalesce(n.n, 0) AS n_passages, reply AS content, '<|' || coalesce(own.role, '') || '|>' || chr(10) || reply AS formatted
FROM own LEFT JOIN best ON best.r = own.r LEFT JOIN place ON place.conv_id = own.conv_id AND place.turn = own.turn LEFT JOIN n ON n.r = own.r
"""

_SIMILAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id
"""

ORACLES: dict[str, str] = {
    "op3_quotes": _REPLIES,
    "op4_jaccard_join": _SIMILAR,
    "op10_line_dedup": _LINES,
}
