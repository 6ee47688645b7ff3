"""The text operators as queries over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.llm import encoding, extraction, ivfpq, langid, lines, mixing, mtree, repair, simhash, suffixes, surrogates, toxicity, whitening
from cellfold.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


@query("op6_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return encoding.digests(encoding.encode(docs, encoding.multilingual()), encoding.multilingual())


@query("op9_language")
def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


@query("op10_simhash")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, folder, "documents", "doc_id", "text"))
    return groups.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


LINES_SQL = r"""
WITH lines AS (
    SELECT doc_id, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
    FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM documents)
), firsts AS (
    SELECT words, min((doc_id, no)) AS first FROM lines WHERE len(words) >= 3 GROUP BY words
), forms AS (
    SELECT words, first, 0 AS place, array_to_string(words, ' ') AS form FROM firsts WHERE len(words) >= 10
    UNION ALL
    SELECT words, first, k, array_to_string(list_concat(words[1:k - 1], words[k + 1:]), ' ')
    FROM (SELECT words, first, unnest(range(1, len(words) + 1)) AS k FROM firsts WHERE len(words) >= 10)
), met AS (
    SELECT words FROM (
        SELECT words, first, place, min(first) OVER (PARTITION BY form, place) AS same,
            min(first) FILTER (place = 0) OVER (PARTITION BY form) AS whole,
            min(first) FILTER (place > 0) OVER (PARTITION BY form) AS part
        FROM forms)
    WHERE (place > 0 AND (same < first OR whole < first)) OR (place = 0 AND part < first)
    GROUP BY words
), kept AS (
    SELECT l.doc_id, l.no, l.line FROM lines l
    WHERE len(words) < 3 OR ((doc_id, no) IN (SELECT first FROM firsts) AND words NOT IN (SELECT words FROM met))
)
SELECT d.doc_id, coalesce(any_value(len(string_split(d.text, chr(10)))), 0)::BIGINT AS n_lines, count(k.no)::BIGINT AS n_kept,
    coalesce(string_agg(k.line, chr(10) ORDER BY k.no), '') AS text
FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "n_lines", "n_kept", "text")


@query("op1_mixing")
def mixing_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents", "doc_id", "text", "source"))


@query("op3_toxicity")
def toxic_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op7_near_vectors")
def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ivfpq.near_vectors(table(spark, folder, "embeddings", "vec_id", "embedding").withColumnRenamed("embedding", "vector"))


TOP_SQL = """
WITH v AS (
    SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
    FROM v q, v x WHERE q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""


@query("op8_top_products", TOP_SQL)
def top_products(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_products(table(spark, folder, "embeddings", "vec_id", "embedding").withColumnRenamed("embedding", "vector"))


@query("op5_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages", "page_id", "url", "html"))


@query("op4_surrogates")
def private_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace(table(spark, folder, "documents", "doc_id", "text"))


REPEATS_SQL = """
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
    SELECT r, p, md5_number(b[p + 1:p + 200]) AS k FROM (SELECT r, b, unnest(range(octet_length(b) - 199)) AS p FROM t)
), met AS (
    SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1
), runs AS (
    SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run
    FROM (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200, true)::INT AS new FROM met)
), spans AS (
    SELECT r, list(a ORDER BY a) AS firsts, list(z ORDER BY a) AS pasts, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans
    FROM (SELECT r, min(p) AS a, max(p) + 200 AS z FROM runs GROUP BY r, run) GROUP BY r
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(array_to_string(list_transform(range(coalesce(n_spans, 0) + 1), lambda i: substr(hex(b), 2 * coalesce(pasts[i], 0) + 1,
        2 * (coalesce(firsts[i + 1], octet_length(b)) - coalesce(pasts[i], 0)))), ''))) AS kept_sha256
FROM t LEFT JOIN spans USING (r)
"""


@query("op13_repeated_strings", REPEATS_SQL)
def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(suffixes.without_repeats(table(spark, folder, "documents", "doc_id", "text")))


REPAIR_SQL = r"""
WITH RECURSIVE drawn AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), faults AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(
        list_concat([4294967295::UBIGINT], list_transform(range(1, length(name) + 1), lambda k: ascii(name[k])::UBIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::UBIGINT)),
            lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::UBIGINT) ELSE y // 2 END)), 4294967295::UBIGINT) % 20 AS f
    FROM drawn
), damaged AS (
    SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM faults, unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), facts AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, count(*) OVER (PARTITION BY conv_id) AS n,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
            WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN '-' ELSE 't' END AS fault
    FROM placed
), best AS (
    SELECT conv_id, max(n) + 1 AS i, [
        {'c': 0, 'a': '', 't': []::VARCHAR[]}, {'c': 10, 'a': 'II', 't': ['user:', 'assistant:']},
        {'c': 5, 'a': 'I', 't': ['assistant:']}, {'c': 0, 'a': '', 't': []::VARCHAR[]}] AS s
    FROM facts GROUP BY conv_id
    UNION ALL
    SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda q: list_min([o[q],
            {'c': o[w[q]].c + 5, 'a': 'I' || o[w[q]].a, 't': list_concat([r[w[q]] || ':'], o[w[q]].t)},
            {'c': o[w[w[q]]].c + 10, 'a': 'II' || o[w[w[q]]].a, 't': list_concat([r[w[q]] || ':', r[w[w[q]]] || ':'], o[w[w[q]]].t)}]))
    FROM (
        SELECT *, list_transform([1, 2, 3, 4], lambda q: list_min([
            {'c': s[q].c + 2, 'a': 'D' || s[q].a, 't': s[q].t},
            {'c': CASE WHEN fault IN ('b', 'd') OR k[q] = 0 THEN 1000000000 ELSE s[greatest(k[q], 1)].c + more END, 'a': 'K' || s[greatest(k[q], 1)].a,
                't': list_concat([role || ':' || text], s[greatest(k[q], 1)].t)},
            {'c': CASE WHEN fault IN ('b', 'd') THEN 1000000000 ELSE s[w[q]].c + 1 + more END, 'a': 'R' || s[w[q]].a,
                't': list_concat([r[w[q]] || ':' || text], s[w[q]].t)}])) AS o
        FROM (
            SELECT f.conv_id, f.i, f.role, f.text, f.fault, b.s, [3, 3, 4, 3] AS w, ['', '', 'user', 'assistant'] AS r, CASE fault WHEN 't' THEN 5 ELSE 0 END AS more,
                CASE initial WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS k
            FROM best b JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1))
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM facts) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s[1].c, 0)::BIGINT AS cost, coalesce(s[1].a, '') AS audit,
    sha256(coalesce(array_to_string(s[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN (SELECT * FROM best WHERE i = 1) b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_conversation_repair", REPAIR_SQL)
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return repair.repair_report(repair.damaged(rows), rows)


@query("op11_whitening")
def whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings", "vec_id", "embedding").withColumnRenamed("embedding", "vector"))
