"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm.decontamination import contamination
from tallygrove.llm.language_id import identify_languages
from tallygrove.llm.mixing import mixed_sizes
from tallygrove.llm.near_dup import near_duplicates
from tallygrove.llm.ngram_join import linked_documents
from tallygrove.llm.pii import pii_digest
from tallygrove.llm.quality_classifier import classify
from tallygrove.llm.quality_rules import score_quality
from tallygrove.llm.sharding import shard_digest
from tallygrove.llm.source_divergence import divergence
from tallygrove.llm.spelling_variants import spelling_variants
from tallygrove.llm.substring_dedup import repeats_digest
from tallygrove.llm.tool_chat import format_chats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_quality_rules,
        op3_pii,
        op4_sharding,
        op5_substring_dedup,
        op6_decontamination,
        op7_near_duplicates,
        op8_tool_chat,
        op9_quality_classifier,
        op10_language_id,
        op11_spelling_variants,
        op12_ngram_join,
        op13_source_divergence,
    )
}


_LINKED_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= {percent} * (x.n + y.n - c.n)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS low FROM documents
  UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node
), least AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id{more}
FROM documents d JOIN least l ON l.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

#: crc32 goes byte by byte over the hexadecimal text, with the table of the polynomial 0xEDB88320 made by eight steps an entry.
_SPELLING_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS byte, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents)
  GROUP BY ALL
), digits AS (SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(0, len(x) // 2),
      lambda i: (16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM digits, crc
), counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % len(run))::BIGINT) || substr(run, (h % len(run))::BIGINT + 2) ELSE run END AS word, sum(n) AS n
  FROM hashed GROUP BY 1
), words AS (SELECT word, n::BIGINT AS n FROM counted WHERE len(word) >= 6 AND n >= 5
), cuts AS (
  SELECT DISTINCT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS p FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT c.rest, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT c.word, c.rest, w.n FROM cuts c JOIN words w ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS top_n, min_by(other, (-n, encode(other))) AS top FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.top_n >= 5 * w.n THEN b.top END AS form, CASE WHEN b.top_n >= 5 * w.n THEN b.top_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), follow AS (
  SELECT word, word AS here, 0 AS k FROM forms
  UNION ALL SELECT f.word, g.form, k + 1 FROM follow f JOIN forms g ON g.word = f.here WHERE g.form IS NOT NULL
), roots AS (SELECT word, max_by(here, k) AS root FROM follow GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""

_DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs
), found AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL
), kept AS (SELECT lang, term, sum(n) AS n FROM found GROUP BY ALL HAVING count(*) >= 30
), langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), own AS (SELECT f.lang, f.source, f.term, sum(f.n) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0) AS total FROM groups g LEFT JOIN own o USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS n,
         1 + (1000000000 * (coalesce(o.n, 0) + 5)::HUGEINT) // (t.total + 5 * l.v)::HUGEINT AS p,
         1 + (1000000000 * (k.n + 5)::HUGEINT) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON (o.lang, o.source, o.term) = (t.lang, t.source, k.term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
    ON (d.lang, d.source, d.item) = (a.lang, a.source, b.source)
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 50
"""

SQL: dict[str, str] = {
    "op7_near_duplicates": _LINKED_SQL.format(percent=75, more=", d.doc_id = l.component_id AS kept"),
    "op11_spelling_variants": _SPELLING_SQL,
    "op12_ngram_join": _LINKED_SQL.format(percent=80, more=""),
    "op13_source_divergence": _DIVERGENCE_SQL,
}
