"""The registered queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.llm import fill_middle, iblt, langid, orc_tokens, packing, pieces, rotated_codes, token_counts, toxicity
from gateflow.llm.common import table
from gateflow.llm.line_runs import drop_repeated_lines
from gateflow.llm.ngram_join import jaccard_components
from gateflow.llm.source_audit import source_divergence
from gateflow.llm.suffix_dedup import remove_repeats
from gateflow.session import run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def sql(name: str, statement: str) -> None:
    SQL[name] = statement


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty here; a pipeline names one folder and keeps it."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), run_folder(spark, "token-counts"),
                                     public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op7_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by streaming Viterbi search over the pieces' own scores, and what they decode to."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "orc-tokens")
    orc_tokens.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return orc_tokens.token_offsets(orc_tokens.read_tokens(spark, folder))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.version_fingerprints(table(spark, sf_dir, "documents"), unit=iblt.SENTENCE)


@query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.link_vectors(table(spark, sf_dir, "embeddings"))


@query
def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


sql("op11_source_divergence_audit", r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
                        lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
held AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term
         GROUP BY ALL),
groups AS (SELECT d.lang, d.source, any_value(coalesce(l.v, 0)) AS v, any_value(coalesce(l.n, 0)) AS n_lang,
                  coalesce((SELECT sum(h.c)::HUGEINT FROM held h WHERE h.lang = d.lang AND h.source = d.source), 0) AS n
           FROM docs d LEFT JOIN langs l ON d.lang = l.lang GROUP BY d.lang, d.source),
cells AS (SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c,
                 1 + (1000000000::HUGEINT * (coalesce(h.c, 0) + 2)) // (g.n + 2 * g.v) AS p,
                 1 + (1000000000::HUGEINT * (k.c + 2)) // (g.n_lang + 2 * g.v) AS q
          FROM groups g JOIN kept k ON g.lang = k.lang
          LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
          UNION ALL
          SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
told AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM cells WHERE c > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM told)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
""")


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


sql("op12_line_dedup", r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
hot AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key
        HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) >= 5)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines,
       count(*) FILTER (h.key IS NOT NULL AND l.doc_id IS DISTINCT FROM h.last) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (h.key IS NULL OR l.doc_id IS NOT DISTINCT FROM h.last), '')) AS kept_sha256
FROM lines l LEFT JOIN hot h ON l.key = h.key GROUP BY l.r
""")


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


sql("op13_fill_in_middle", r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
         [('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 8 * k + 1, 8))::BIGINT for k in range(4)] AS h
  FROM documents),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text
                 WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
                 ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END AS output
  FROM cut)
SELECT doc_id, n, form, (CASE WHEN form <> 'plain' THEN a END)::DOUBLE AS prefix_chars, (CASE WHEN form <> 'plain' THEN b - a END)::DOUBLE AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                   WHEN 'psm' THEN substr(string_split(output, '<S>')[1], 4) || string_split(output, '<M>')[2] || string_split(string_split(output, '<S>')[2], '<M>')[1]
                   ELSE string_split(string_split(output, '<P>')[2], '<M>')[1] || string_split(output, '<M>')[2] || substr(string_split(output, '<P>')[1], 4) END) AS restored_sha256
FROM made
""")
