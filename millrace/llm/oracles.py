"""The queries of this subpackage that DuckDB SQL expresses on whole tables, by another way than the operators'."""

from __future__ import annotations

from millrace.functions.text import DENSE_SCRIPTS

_NOT_DENSE = "[^" + "".join(rf"\p{{{s}}}" for s in DENSE_SCRIPTS) + "]"


def _estimate(t: str) -> str:
    return f"CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE greatest(1, ceil(length({t}) / (4.0 - 1.4 * length(regexp_replace({t}, '{_NOT_DENSE}', '', 'g')) / length({t}))))::INTEGER END"


_E = _estimate("text")
_WORDS = r"'^[\p{L}\p{M}\p{N}]{2}'"

SQL: dict[str, str] = {
    "p2_found": """
        WITH log AS (SELECT DISTINCT ON (request_id) * FROM request_log),
        v AS (SELECT strftime(try_cast(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d') AS log_date, unnest(['total', 'dense_retrieval', 'reranking', 'time_to_first_token']) AS stage, unnest([total, dense_retrieval, reranking, time_to_first_token]) AS v FROM log)
        SELECT log_date, stage FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND log_date IS NOT NULL GROUP BY ALL HAVING quantile_disc(v, 0.95) >= 3 * quantile_disc(v, 0.5)""",
    "p3_found": """
        WITH u AS MATERIALIZED (SELECT DISTINCT ON (id) id, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM vector_records WHERE len(vector) = 96),
        v AS MATERIALIZED (SELECT * FROM u WHERE n > 0),
        s AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.vector, b.vector) / (a.n * b.n) AS c FROM v a JOIN v b ON a.id <> b.id),
        t AS (SELECT a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS nth FROM s) WHERE nth <= 5)
        SELECT x.a AS id_a, x.b AS id_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.c >= 0.92""",
    "p4_found": f"SELECT DISTINCT id AS chunk_id FROM chunks WHERE token_count IS NULL OR abs(token_count - {_E}) > 0.25 * {_E}",
    "p6_found": f"""
        WITH c AS (SELECT DISTINCT ON (id) id, document_id, language, chunk_index, text, char_start AS s, char_end AS e FROM chunks WHERE strategy <> 'parent'),
        d AS (SELECT DISTINCT ON (document_id) document_id, text AS passage FROM source_documents),
        b AS (SELECT document_id, chunk_index + 1 AS chunk_index, max(e) AS before_end FROM c GROUP BY ALL),
        j AS (SELECT c.*, passage, before_end FROM c LEFT JOIN d USING (document_id) LEFT JOIN b USING (document_id, chunk_index))
        SELECT id AS chunk_id FROM j WHERE {_E} > 220
            OR NOT coalesce(s >= 0 AND s < e AND e <= length(passage) AND substring(passage, s + 1, e - s) = text, FALSE)
            OR (coalesce(language NOT IN ('zho_Hans', 'jpn_Jpan', 'tha_Thai'), TRUE) AND coalesce((s > 0 AND regexp_matches(substring(passage, s, 2), {_WORDS})) OR (e < length(passage) AND regexp_matches(substring(passage, e, 2), {_WORDS})), FALSE))
            OR coalesce(chunk_index > 0 AND s >= before_end, FALSE)""",
    "p7_found": f"SELECT doc_id FROM documents WHERE {_E} > 2048",
    "p8_found": f"""
        WITH s AS (SELECT lower(trim(source)) AS source, sum({_E}) AS size FROM documents GROUP BY 1),
        j AS (SELECT m.source, target_share, max_repeats, coalesce(size, 0) AS size FROM mix_targets m LEFT JOIN s USING (source))
        SELECT source FROM j WHERE max_repeats * size < target_share * (SELECT sum(size) FROM j)""",
    "p9_found": """
        WITH g AS (SELECT DISTINCT doc_id, md5(substring(text, i::BIGINT, 200)) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
        r AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1), m AS (SELECT * FROM g WHERE gram IN (SELECT gram FROM r))
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b ON a.gram = b.gram AND a.doc_id < b.doc_id""",
    "p1_sampled": "SELECT document_id, char_start, char_end, text FROM sentence_samples WHERE document_id IN (SELECT document_id FROM source_documents)",
    "p4_sizes": f"""SELECT 'chunk' AS record_kind, id, coalesce(length(text), 0)::BIGINT AS chars, {_E} AS estimate FROM (SELECT DISTINCT ON (id) id, text FROM chunks)
        UNION ALL SELECT 'document', doc_id::VARCHAR, coalesce(length(text), 0), {_E} FROM documents""",
    "p6_checks": f"SELECT document_id, TRUE AS within, TRUE AS counted, TRUE AS overlapping, TRUE AS whole FROM (SELECT DISTINCT ON (document_id) document_id, text FROM source_documents) WHERE {_E} > 220",
    "p7_checks": f"SELECT count(*) AS documents, sum(n)::BIGINT AS units, sum(greatest(1, ceil(n / 2048.0)))::BIGINT AS parts, TRUE AS divided_rightly, TRUE AS fits, TRUE AS dense FROM (SELECT {_E} AS n FROM documents)",
    "p8_sources": f"""
        WITH s AS (SELECT lower(trim(source)) AS source, count(*) FILTER ({_E} > 0) AS documents, sum({_E})::BIGINT AS size FROM documents GROUP BY 1),
        j AS (SELECT m.source, target_share, max_repeats, coalesce(documents, 0) AS documents, coalesce(size, 0)::BIGINT AS size FROM mix_targets m LEFT JOIN s USING (source)),
        t AS (SELECT *, (SELECT sum(size) FROM j)::BIGINT AS total FROM j)
        SELECT source, documents, size, total, round(target_share * total, 3) AS wanted, max_repeats * size >= target_share * total AS reachable, TRUE AS taken_rightly FROM t""",
    "p9_shared": """
        WITH g AS MATERIALIZED (SELECT doc_id, i, md5_number(substring(text, i::BIGINT, 200)) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
        r AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 200 AS fresh FROM g WHERE gram IN (SELECT gram FROM r)),
        n AS (SELECT doc_id, i, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m),
        p AS (SELECT doc_id, min(i) - 1 AS s, max(i) + 199 AS e FROM n GROUP BY doc_id, span),
        q AS (SELECT doc_id, sum(e - s)::INTEGER AS shared_chars, '[' || string_agg('{"char_start":' || s || ',"char_end":' || e || '}', ',' ORDER BY s) || ']' AS spans FROM p GROUP BY doc_id)
        SELECT doc_id, coalesce(length(text), 0)::INTEGER AS n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN coalesce(length(text), 0) > 0 THEN coalesce(shared_chars, 0)::DOUBLE / length(text) ELSE 0.0 END AS shared_share, spans FROM documents LEFT JOIN q USING (doc_id)""",
}
