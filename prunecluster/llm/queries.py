"""The queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prunecluster.llm import chat, embed_dedup, exact_dedup, filter_audit, langid, licenses, line_dedup, packing, pieces, simhash, token_file, warc, whitening
from prunecluster.llm.batches import public_tokenizer


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_embedding_dedup(spark, folder):
    return embed_dedup.embedding_dedup(table(spark, folder, "embeddings"))


def op2_best_fit_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizer())


def op3_simhash_dedup(spark, folder):
    return simhash.simhash_dedup(table(spark, folder, "documents"))


def op4_line_dedup(spark, folder):
    return line_dedup.line_dedup(table(spark, folder, "documents"))


def op5_chat_format(spark, folder):
    return chat.repair_chats(table(spark, folder, "conversations"))


def op6_sentencepiece(spark, folder):
    return pieces.round_trip(table(spark, folder, "documents"), pieces.public_model())


def op7_exact_dedup(spark, folder):
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op8_language_id(spark, folder):
    return langid.language_id(table(spark, folder, "documents"))


def op9_token_file(spark, folder):
    return token_file.token_output(table(spark, folder, "documents"), public_tokenizer())


def op10_warc(spark, folder):
    return warc.warc_round_trip(table(spark, folder, "pages")).drop("problem")


def op11_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_filter_audit(spark, folder):
    return filter_audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("filter")


def op13_license_scan(spark, folder):
    return licenses.digest(licenses.scan_licenses(table(spark, folder, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_embedding_dedup, op2_best_fit_packing, op3_simhash_dedup, op4_line_dedup, op5_chat_format,
    op6_sentencepiece, op7_exact_dedup, op8_language_id, op9_token_file,
    op10_warc, op11_whitening, op12_filter_audit, op13_license_scan,
)}

ORACLES = {
    "op1_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
              AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
        r AS (
            SELECT a AS vec_id, a AS other FROM (SELECT DISTINCT a FROM l)
            UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.least, e.vec_id) AS component_id,
               coalesce(c.least, e.vec_id) = e.vec_id AS kept
        FROM embeddings e
        LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) n ON n.a = e.vec_id
        LEFT JOIN (SELECT vec_id, min(other) AS least FROM r GROUP BY vec_id) c ON c.vec_id = e.vec_id""",
    "op4_line_dedup": """
        WITH l AS (
            SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents),
        w AS (
            SELECT doc_id, i, line, lead(line) OVER d AS second, lead(line, 2) OVER d AS third,
                   len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
            FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        v AS (SELECT *, words + len(regexp_extract_all(second, '[^\\x20\\x09-\\x0D]+')) AS of_two FROM w),
        c AS (
            SELECT doc_id, i, 3 AS n, line, second, third FROM v WHERE third IS NOT NULL
            UNION ALL SELECT doc_id, i, 1, line, NULL, NULL FROM v WHERE words >= 50
            UNION ALL SELECT doc_id, i, 2, line, second, NULL FROM v WHERE words < 50 AND of_two >= 50),
        r AS (SELECT doc_id, i, n FROM c QUALIFY row_number() OVER (PARTITION BY n, line, second, third ORDER BY doc_id, i) > 1),
        g AS (SELECT DISTINCT doc_id, i + unnest(range(n)) AS i FROM r)
        SELECT l.doc_id,
               CASE WHEN bool_and(l.text IS NULL) THEN NULL
                    ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') END AS text,
               count(*) AS n_lines, count(g.i) AS n_removed
        FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id""",
    "op7_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM t""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS model FROM p)
        SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> model THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> model THEN model END AS refers_to
        FROM m""",
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
            FROM documents),
        y AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
        m AS (
            SELECT part, good, bad,
                   [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                    regexp_matches(t, '[#$%&*|]'), coalesce(least < d.doc_id, false)] AS f
            FROM d LEFT JOIN y ON y.doc_id = d.doc_id),
        c AS (
            SELECT part, f, count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(bad, false)) AS bad,
                   len(list_filter(f, lambda v: v)) AS fails
            FROM m GROUP BY part, f),
        i AS (SELECT unnest(range(1, 6)) AS i),
        o AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (
            SELECT part, o, i.i AS step, n, good, bad, fails, f[o[i.i]] AS here,
                   len(list_filter(o[1:i.i - 1], lambda k: f[k])) > 0 AS before
            FROM c, o, i),
        r AS (
            SELECT part, o, step,
                   sum(CASE WHEN here OR before THEN 0 ELSE n END)::BIGINT AS kept,
                   sum(CASE WHEN here AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN here AND before THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN here AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN here AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN here AND NOT before THEN bad ELSE 0 END)::BIGINT AS toxic_lost
            FROM s GROUP BY part, o, step)
        SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step::INTEGER AS step,
               kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, o[step])::BIGINT AS shapley
        FROM r""",
    "op13_license_scan": licenses.digest_sql(),
}
