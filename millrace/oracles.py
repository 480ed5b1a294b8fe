"""The queries again, written independently as DuckDB SQL over the same tables."""

from __future__ import annotations

from millrace.fixtures import FIXTURES
from millrace.operators.guard import RULES
from millrace.oracles_chunking import CHUNKING, DENSE_SCRIPTS, LANGUAGE_NAMES, SCRIPTS, STOPWORDS

INPUT_GUARDS = ("prompt_injection", "jailbreak", "toxicity")
REFUSALS = {
    "prompt_injection": "This request was blocked because it tried to override the assistant’s instructions.",
    "jailbreak": "This request was blocked because it tried to bypass safety constraints.",
    "toxicity": "This request was blocked because it asks for harmful content.",
}
REFUSAL = "This request was blocked by a safety guardrail."

_TYPES = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return f"'{x}'::DOUBLE"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, list):
        return "[" + ", ".join(_literal(v) for v in x) + "]"
    return "'" + x.replace("'", "''") + "'"


def values(name: str) -> str:
    """A written table of plain columns as a subquery."""
    schema, rows = FIXTURES[name]
    columns = [c.split(" ") for c in schema.split(", ")]
    typed = ", ".join(f"CAST({n} AS {_TYPES[t]}) AS {n}" for n, t in columns)
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT {typed} FROM (VALUES {body}) AS v({', '.join(n for n, _ in columns)}))"


SP = r"[\p{Z}\t\n\x0B\f\r\x{0085}\x{FEFF}]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SP}+|{SP}+$', '', 'g')"


def tokens(t: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '')"


STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def content(t: str) -> str:
    return f"list_filter({tokens(t)}, lambda y: length(y) > 1 AND NOT list_contains({STOP}, y))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len(list_distinct({a})) + len(list_distinct({b})) - {both}) END"


def covered(needles: str, hay: str) -> str:
    return f"CASE WHEN len({needles}) = 0 THEN 0.0 ELSE len(list_filter({needles}, lambda z: list_contains({hay}, z)))::DOUBLE / len({needles}) END"


def at_word(t: str, n: int) -> str:
    head = f"left({t}, {n})"
    space = f"(length({head}) - instr(reverse({head}), ' '))"
    return f"CASE WHEN instr({head}, ' ') > 0 AND {space} > {n} * 0.6 THEN left({t}, {space}) ELSE {head} END"


def truncated(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace({at_word(t, n)}, '{SP}+$', '') || '…' END"


_NOT_DENSE = "[^" + "".join(rf"\p{{{s}}}" for s in DENSE_SCRIPTS) + "]"


def estimate(t: str) -> str:
    return f"CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE greatest(1, ceil(length({t}) / (4.0 - 1.4 * length(regexp_replace({t}, '{_NOT_DENSE}', '', 'g')) / length({t}))))::INTEGER END"


CHUNKS = "chunk_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, token_count DESC NULLS LAST, topic DESC NULLS LAST, query_text DESC NULLS LAST) AS nth FROM chunks) WHERE nth = 1)"
LOG = "log AS (SELECT DISTINCT ON (request_id) * FROM request_log)"


def bm25(docs: str, key: str, searched: str = "TRUE", distinct: bool = False) -> str:
    """CTEs up to scored(query_id, key, score)."""
    asked = "count(DISTINCT 1)" if distinct else "count(*)"
    return f"""
    docs AS (SELECT {key} AS k, {tokens('text')} AS toks, {searched} AS searched FROM {docs}),
    stats AS (SELECT count(*) AS n, greatest(1.0, sum(coalesce(len(toks), 0)) / count(*)) AS avgdl FROM docs),
    posts AS (SELECT k, searched, len(toks) AS len, term, count(*) AS tf FROM (SELECT k, searched, toks, unnest(toks) AS term FROM docs) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
    q AS (SELECT query_id, term, {asked} AS n FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM evaluation_cases) GROUP BY ALL),
    qw AS (SELECT query_id, q.term, q.n * ln(1 + (stats.n - df + 0.5) / (df + 0.5)) AS idf FROM q JOIN df USING (term), stats),
    scored AS (SELECT query_id, k, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 9) AS score
        FROM posts JOIN qw USING (term), stats WHERE searched GROUP BY ALL HAVING round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 9) > 0)"""


def top(name: str, source: str, n: int, key: str = "k", score: str = "score") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, {key}) AS rank FROM {source}) WHERE rank <= {n})"


BM25_CHUNKS = f"WITH {CHUNKS}, {bm25('chunk_rows', 'id', chr(39).join(['strategy <> ', 'parent', '']))}, {top('best', 'scored', 10)}"

_DENSE = f"""
    vecs AS (SELECT DISTINCT ON (id) id, vector, is_parent FROM vector_records WHERE len(vector) = 96),
    qv AS (SELECT metadata.query_id AS query_id, arg_min(vector, id) AS qvec FROM vector_records WHERE len(vector) = 96 AND metadata.query_id IN (SELECT query_id FROM evaluation_cases) GROUP BY 1),
    dscored AS (SELECT query_id, id AS k, round(list_dot_product(qvec, vector), 9) AS score FROM qv, vecs WHERE NOT is_parent),
    {top('dense', 'dscored', 20)}, {top('sparse', 'scored', 20)},
    fused0 AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.k, s.k) AS k, d.rank AS dense_rank, s.rank AS sparse_rank, d.score AS dense_score,
        round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 12) AS fused_score
        FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.k = s.k),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, k) AS rank FROM fused0)"""
HYBRID = f"WITH {CHUNKS}, {bm25('chunk_rows', 'id', chr(39).join(['strategy <> ', 'parent', '']))}, {_DENSE}"
AGREEMENT = "agree AS (SELECT query_id, CASE WHEN count(dense_rank) = 0 OR count(sparse_rank) = 0 THEN 0.0 ELSE count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NOT NULL)::DOUBLE / count(*) END AS agreement FROM fused GROUP BY 1)"
RERANK = f"""
    cand AS (SELECT f.query_id, f.k, f.rank, f.fused_score, f.dense_score, c.text, c.parent_chunk, c.document_id, list_distinct({content('e.query')}) AS terms, {tokens('c.text')} AS toks
        FROM fused f JOIN chunk_rows c ON c.id = f.k JOIN evaluation_cases e ON e.query_id = f.query_id WHERE f.rank <= 10),
    placed AS (SELECT *, list_filter(list_transform(terms, lambda t: coalesce(list_position(toks, t), 0)), lambda p: p > 0) AS places, greatest(max(fused_score) OVER (PARTITION BY query_id), 1e-9) AS best_prior FROM cand),
    near AS (SELECT *, CASE WHEN len(places) = 0 THEN 0.0 WHEN len(places) = 1 THEN 0.5 WHEN list_max(places) - list_min(places) <= len(places) - 1 THEN 1.0
        ELSE greatest(0.0, 1 - (list_max(places) - list_min(places) - (len(places) - 1))::DOUBLE / len(toks)) END AS proximity FROM placed),
    rescored AS (SELECT *, round(CASE WHEN len(terms) = 0 THEN fused_score ELSE greatest(0.0, least(1.0, 0.5 * len(places) / len(terms) + 0.2 * proximity + 0.3 * fused_score / best_prior)) END, 9) AS rerank_score FROM near),
    reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, k) AS rank_after FROM rescored) WHERE rank_after <= 5)"""

QRELS = "qrels AS (SELECT DISTINCT query_id, unnest(expected_document_ids) AS document_id FROM evaluation_cases)"
RANKED = "ranked AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY best, document_id) AS rank FROM (SELECT best.query_id, c.document_id, min(rank) AS best FROM best JOIN chunk_rows c ON c.id = best.k GROUP BY 1, 2))"


def quality(k: int) -> str:
    return f"""(SELECT n.query_id, n.relevant, coalesce(m.found / n.relevant, 0) AS recall, coalesce(m.found / nullif(m.shown, 0), 0) AS precision, coalesce(1.0 / m.first, 0) AS reciprocal_rank,
        coalesce(m.gain / list_sum(list_transform(range(1, least({k}, n.relevant) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg, m.first IS NOT NULL AS hit
        FROM (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY 1) n LEFT JOIN (
            SELECT r.query_id, count(*) FILTER (x.document_id IS NOT NULL AND rank <= {k})::DOUBLE AS found, count(*) FILTER (rank <= {k})::DOUBLE AS shown, min(rank) FILTER (x.document_id IS NOT NULL) AS first,
            sum(CASE WHEN x.document_id IS NOT NULL AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS gain
            FROM ranked r LEFT JOIN qrels x USING (query_id, document_id) GROUP BY 1) m USING (query_id))"""


def measured(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) AND {c} >= 0 AND NOT isinf({c}) THEN {c} END"


def _zero(c: str) -> str:
    return f"coalesce({measured(c)}, 0)"


_RETRIEVAL = f"greatest({_zero('dense_retrieval')}, {_zero('sparse_retrieval')}) + {_zero('fusion')}"
_PATH = f"{_zero('guardrails_pre')} + {_zero('embedding')} + ({_RETRIEVAL}) + {_zero('diversity')} + {_zero('reranking')} + {_zero('expansion')}"
_STAGES = {"embedding": measured("embedding"), "retrieval": _RETRIEVAL, "reranking": measured("reranking"), "generation": measured("generation"), "transcription": measured("transcription"), "retrieval_path": _PATH, "total": measured("total")}


def percentiles(source: str, value: str, by: str) -> str:
    ranks = ", ".join(f"quantile_disc({value}, {r}) AS {n}" for n, r in (("p50", 0.5), ("p70", 0.7), ("p95", 0.95), ("p99", 0.99)))
    return f"SELECT {by}, count({value})::BIGINT AS count, round(avg({value}), 4) AS mean, min({value}) AS least, {ranks}, max({value}) AS p100 FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}"


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{n}' AS stage, round({v}, 2) AS ms FROM log" for n, v in _STAGES.items()) + ")"
_AT = "try_cast(created_at AS TIMESTAMPTZ)"
_UTC = f"({_AT} AT TIME ZONE 'UTC')"


# White space as the rules mean it, held here apart from the operators'.
WHITE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _re2(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''").replace(r"[\s\S]", "(?s:.)").replace(r"\s", WHITE)


def _rule(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, '{_re2(pattern)}')"


def rule_score(t: str, group: str) -> str:
    return "least(1.0, round(" + " + ".join(f"CASE WHEN {_rule(t, r.pattern)} THEN {r.weight} ELSE 0.0 END" for r in RULES if r.group == group) + ", 4))"


def _evidence(t: str, group: str) -> str:
    rows = []
    for r in RULES:
        if r.group == group:
            rows.append(f"CASE WHEN {_rule(t, r.pattern)} THEN '{r.name}: ' || left(trim(regexp_replace(regexp_extract({t}, '{_re2(r.pattern)}'), '{WHITE}+', ' ', 'g')), 120) END")
    return f"array_to_string(list_filter([{', '.join(rows)}], lambda e: e IS NOT NULL), ' ; ')"


_REPORT = f"asked_prompts AS MATERIALIZED (SELECT key, coalesce(query, '') AS asked FROM (SELECT 'r' || request_id AS key, min(query) AS query FROM request_log GROUP BY 1 UNION ALL SELECT key, query FROM {values('prompts')})), " + "report AS (" + " UNION ALL ".join(f"SELECT key, '{g}' AS guard, {i} AS position, {rule_score(chr(34) + 'asked' + chr(34), g)} AS score, {_evidence('asked', g)} AS evidence FROM asked_prompts" for i, g in enumerate(INPUT_GUARDS)) + "), judged AS (SELECT *, CASE WHEN score >= 0.8 THEN 'block' WHEN score >= 0.45 THEN 'warn' ELSE 'pass' END AS verdict FROM report)"
_REFUSED = "CASE blocked_by " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REFUSALS.items()) + f" ELSE '{REFUSAL}' END"


def clamp(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE greatest(0.0, least(1.0, {c})) END"


BLEND = f"0.35 * ({clamp('top_score')}) + 0.3 * ({clamp('groundedness')}) + 0.15 * ({clamp('mean_score')}) + 0.1 * ({clamp('agreement')}) + 0.1 * ({clamp('coverage')})"
LOSSES = ", ".join(f"{{'loss': {w} - {w} * ({clamp(n)}), 'o': {-i}, 'f': '{n}'}}" for i, (n, w) in enumerate((("top_score", 0.35), ("groundedness", 0.3), ("mean_score", 0.15), ("agreement", 0.1), ("coverage", 0.1))))
_TOPIC = f"coalesce(query_text, topic, '')"
_TOPIC_SQL = f"CASE WHEN {strip(_TOPIC)} <> '' THEN {truncated('regexp_replace(' + strip(_TOPIC) + ', ' + chr(39) + '^([.]|' + SP + ')+' + chr(39) + ', ' + chr(39) * 2 + ')', 90)} ELSE {truncated(strip(chr(40) + 'coalesce(text, ' + chr(39) * 2 + '))'), 60)} END"
_SUGGEST = f"sug AS (SELECT query_id, language, arg_min(t, id) AS text FROM (SELECT query_id, language, id, {strip('coalesce(query_text, ' + chr(39) * 2 + ')')} AS t FROM chunk_rows) WHERE coalesce(query_id, '') <> '' AND t <> '' AND length(t) <= 140 GROUP BY 1, 2)"
_QID = "regexp_replace(coalesce(query_id, ''), 'n$', '')"
trigram_list = lambda t: f"CASE WHEN length({t}) < 3 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({t}) - 1), lambda i: substring({t}, i::BIGINT, 3))) END"


def plain(t: str) -> str:
    return strip(f"regexp_replace(lower({t}), '{SP}+', ' ', 'g')")


def _html(t: str) -> str:
    out = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "''"), ("&nbsp;", " ")):
        out = f"replace({out}, '{a}', '{b}')"
    return strip(f"regexp_replace({out}, '{SP}{{2,}}', ' ', 'g')")


_SCRIPT_COUNTS = ", ".join(rf"length(regexp_replace(text, '[^\p{{{s}}}]', '', 'g'))" for s in SCRIPTS)
_NAMES = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_NAMES.items()) + " ELSE language END"

_SPOKEN = "answer"
for _pattern, _to in ((r"```(?s:.*?)```", " "), (r"\[\d+\](\[\d+\])*", " "), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (r"[*_~`>#|]", " "), (SP + "+", " ")):
    _SPOKEN = f"regexp_replace({_SPOKEN}, '{_pattern}', '{_to}', 'g')"

EVIDENCE = f"""{HYBRID}, {RERANK}, {AGREEMENT},
        h AS (SELECT r.query_id, max(greatest(0, least(1, coalesce(dense_score, 0)))) AS top, avg(greatest(0, least(1, coalesce(dense_score, 0)))) AS mean, min(greatest(0, least(1, coalesce(dense_score, 0)))) AS low, count(*) AS chunks,
            list_distinct(flatten(list({tokens("r.text || ' ' || coalesce(p.text, '')")}))) AS ctx FROM reranked r LEFT JOIN chunk_rows p ON p.id = r.parent_chunk GROUP BY 1),
        j AS (SELECT e.query_id, coalesce(top, 0) AS top, coalesce(mean, 0) AS mean, coalesce(low, 0) AS low, coalesce(chunks, 0) AS chunks, coalesce(agreement, 0) AS agreement, {content("coalesce(e.query, '')")} AS needles, coalesce(ctx, []::VARCHAR[]) AS ctx, {rule_score("coalesce(e.query, '')", "out_of_scope")} AS hint
            FROM evaluation_cases e LEFT JOIN h USING (query_id) LEFT JOIN agree USING (query_id)),
        k AS (SELECT *, {covered('needles', 'ctx')} AS coverage, CASE WHEN top > 0 THEN 1 - least(1, (CASE WHEN chunks > 1 THEN top - low ELSE 0 END) / greatest(top, 1e-6)) ELSE 0 END AS consistency FROM j),
        l AS (SELECT *, 0.5 * agreement + 0.3 * consistency + 0.2 * least(1, chunks / 3.0) AS verification FROM k)"""

ORACLES: dict[str, str] = {
    "bm25_topk": f"{BM25_CHUNKS} SELECT query_id, k AS id, rank, score FROM best",
    "bm25_distinct_topk": f"WITH {bm25('documents', 'doc_id', distinct=True)}, {top('best', 'scored', 10)} SELECT query_id, k AS doc_id, rank, score FROM best",
    "bm25_term_stats": f"WITH t AS (SELECT DISTINCT doc_id, unnest({tokens('text')}) AS term FROM documents) SELECT term, row_number() OVER (ORDER BY term) AS term_id, count(*) AS frequency FROM t GROUP BY term",
    "bm25_corpus_stats": f"SELECT count(*) AS documents, greatest(1.0, sum(coalesce(len({tokens('text')}), 0)) / count(*)) AS average_length FROM documents",
    "doc_vectors": f"WITH {bm25('documents', 'doc_id')} SELECT k AS doc_id, term, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)), 9) AS weight FROM posts, stats",
    "query_vectors": f"WITH {bm25('documents', 'doc_id')} SELECT query_id, term, round(idf, 9) AS idf FROM qw WHERE idf > 0",
    "tokenize_stats": f"SELECT doc_id, len({tokens('t')})::INTEGER AS tokens, len(list_distinct({tokens('t')}))::INTEGER AS terms, len({content('t')})::INTEGER AS content_tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "normalize_ws": rf"SELECT doc_id, md5({strip('regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' + repr('[\\x{200B}-\\x{200D}\\x{FEFF}]').replace(chr(92) * 2, chr(92)) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + chr(92) + 'r' + chr(92) + 'n?' + chr(39) + ', chr(10), ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '[ ' + chr(92) + 't]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + chr(92) + 'n{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')}) AS digest FROM documents",
    "truncate_text": f"SELECT doc_id, {truncated('text', 90)} AS short, CASE WHEN length(s) <= 512 THEN s ELSE {at_word('s', 512)} END AS clamped FROM (SELECT doc_id, text, {strip('text')} AS s FROM documents)",
    "token_estimate": f"SELECT doc_id, {estimate('text')} AS estimate FROM documents",
    "script_detect": f"SELECT document_id, CASE WHEN coalesce(list_max(c), 0) = 0 THEN 'Unknown' ELSE [{', '.join(repr(s) for s in SCRIPTS)}][list_position(c, list_max(c))] END AS script FROM (SELECT document_id, [{_SCRIPT_COUNTS}] AS c FROM source_documents)",
    "language_names": f"SELECT language, {_NAMES} AS name, count(*) AS n FROM source_documents GROUP BY language",
    "trigram_jaccard": f"WITH p AS (SELECT query_id, query, english_query, {plain('query')} AS a, {plain('english_query')} AS b FROM evaluation_cases), g AS (SELECT *, {trigram_list('a')} AS ga, {trigram_list('b')} AS gb FROM p) SELECT query_id, round(CASE WHEN coalesce(length(query), 0) = 0 OR coalesce(length(english_query), 0) = 0 THEN 0.0 WHEN query = english_query THEN 1.0 ELSE {jaccard('ga', 'gb')} END, 9) AS similarity FROM g",
    "token_overlap": f"WITH t AS (SELECT query_id, {tokens('coalesce(query, ' + chr(39) * 2 + ')')} AS a, {tokens('coalesce(answer, ' + chr(39) * 2 + ')')} AS b, {content('coalesce(query, ' + chr(39) * 2 + ')')} AS c FROM evaluation_cases) SELECT query_id, round({jaccard('a', 'b')}, 9) AS jaccard, round({covered('c', 'b')}, 9) AS coverage FROM t",
    "chunk_uuid": f"WITH {CHUNKS}, h AS (SELECT id, sha1(concat_ws('::', document_id, passage_id, strategy, chunk_index)) AS h FROM chunk_rows) SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab89ab89ab89ab'[strpos('0123456789abcdef', h[17:17])] || h[18:20] || '-' || h[21:32] AS made FROM h",
    "metadata_headers": f"WITH {CHUNKS}, t AS (SELECT id, language, source, text, {_TOPIC_SQL} AS topic FROM chunk_rows), h AS (SELECT *, concat_ws(' | ', CASE WHEN topic <> '' THEN 'topic: ' || topic END, CASE WHEN language <> '' THEN 'language: ' || language END, CASE WHEN source <> '' THEN 'source: ' || source END) AS p FROM t) SELECT id, topic, CASE WHEN p = '' THEN '' ELSE '[' || p || ']' END AS header, md5(CASE WHEN p = '' THEN coalesce(text, '') ELSE '[' || p || ']' || chr(10) || coalesce(text, '') END) AS embedded FROM h",
    "html_strip": f"WITH p AS (SELECT page_id, {_html('html')} AS plain FROM {values('pages')}) SELECT page_id, plain, CASE WHEN length(plain) <= 60 THEN plain WHEN instr(left(plain, 60), ' ') > 0 THEN left(plain, 60 - instr(reverse(left(plain, 60)), ' ')) || '…' ELSE left(plain, 59) || '…' END AS snippet FROM p",
    "dense_topk": f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS k, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), {top('best', 's', 10)} SELECT query_id, k AS vec_id, score, rank FROM best",
    "unit_vectors": "WITH v AS (SELECT DISTINCT ON (id) id, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM vector_records WHERE len(vector) > 0) SELECT id, round(CASE WHEN n = 0 THEN 0 ELSE list_sum(vector) / n END, 6) AS total, round(CASE WHEN n = 0 THEN 0 ELSE vector[1] / n END, 6) AS head FROM v",
    "rrf_fusion": f"{HYBRID} SELECT query_id, k AS id, rank, round(fused_score, 9) AS fused_score, dense_rank, sparse_rank, concat_ws('+', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN sparse_rank IS NOT NULL THEN 'sparse' END) AS matched_by FROM fused WHERE rank <= 10",
    "arm_agreement": f"{HYBRID}, {AGREEMENT} SELECT query_id, round(agreement, 9) AS agreement FROM agree",
    "heuristic_rerank": f"{HYBRID}, {RERANK} SELECT query_id, k AS id, rank AS rank_before, rank_after, rank - rank_after AS gain, round(rerank_score, 6) AS rerank_score FROM reranked",
    "candidate_similarity": f"{HYBRID}, c AS (SELECT f.query_id, f.rank, {plain('coalesce(text, ' + chr(39) * 2 + ')')} AS p FROM fused f JOIN chunk_rows ON id = k), g AS (SELECT query_id, rank, {trigram_list('p')} AS g FROM c) SELECT a.query_id, a.rank AS rank_a, b.rank AS rank_b, round({jaccard('a.g', 'b.g')}, 9) AS similarity FROM g a JOIN g b ON a.query_id = b.query_id AND a.rank < b.rank",
    "parent_expansion": f"{HYBRID}, {RERANK} SELECT r.query_id, r.k AS id, coalesce(length(p.text), 0) AS parent_chars FROM reranked r LEFT JOIN chunk_rows p ON p.id = r.parent_chunk",
    "filtered_search": "SELECT DISTINCT id, metadata.language AS language FROM vector_records WHERE NOT is_parent AND metadata.language IN ('hin_Deva', 'tam_Taml') AND metadata.strategy IN ('overlap', 'semantic', 'recursive')",
    "point_lookup": f"WITH {CHUNKS} SELECT id, document_id, strategy, 1.0::DOUBLE AS score FROM chunk_rows WHERE id IN (SELECT parent_chunk FROM chunk_rows)",
    "semantic_cache": """
        WITH v AS MATERIALIZED (SELECT id, any_value(vector) AS vector, max(upserted_at) AS stored, min(metadata.query_id) AS query_id, min(metadata.language) AS lang FROM vector_records WHERE len(vector) = 96 AND NOT is_parent GROUP BY id),
        u AS MATERIALIZED (SELECT id, stored, query_id, lang, sqrt(list_dot_product(vector, vector)) AS n, vector FROM v),
        w AS MATERIALIZED (SELECT id, stored, query_id, lang, CASE WHEN n > 0 THEN list_transform(vector, lambda x: x / n) ELSE vector END AS vector FROM u),
        a AS (SELECT query_id AS request_id, arg_min(lang, id) FILTER (lang IS NOT NULL) AS lang0, min(id) AS id FROM w WHERE query_id IN (SELECT query_id FROM evaluation_cases) GROUP BY 1),
        s AS (SELECT request_id, e.id AS entry_id, round(list_dot_product(r.vector, e.vector), 9) AS similarity FROM a JOIN w r ON r.id = a.id JOIN w e ON e.lang = r.lang AND e.stored < r.stored AND e.stored > r.stored - INTERVAL 30 DAY)
        SELECT request_id, arg_min(entry_id, {'s': -similarity, 'e': entry_id}) AS entry_id, max(similarity) AS similarity FROM s WHERE similarity > 0.97 GROUP BY 1""",
    "exact_cache": f"WITH {LOG}, f AS (SELECT request_id, coalesce(language, chr(0)) AS lang, {_AT} AS t, {strip("regexp_replace(" + plain("coalesce(query, " + chr(39) * 2 + ")") + ", '[?!.।]+$', '')")} AS form FROM log), g AS (SELECT * FROM f WHERE t IS NOT NULL AND form <> '') SELECT a.request_id, max(epoch_ms(b.t)) AS stored_ms FROM g a JOIN g b ON a.form = b.form AND a.lang = b.lang AND epoch_ms(a.t) - epoch_ms(b.t) > 0 AND epoch_ms(a.t) - epoch_ms(b.t) < 300000 GROUP BY 1",
    "speech_texts": f"SELECT key, md5(left({strip(_SPOKEN)}, 2500)) AS spoken FROM (SELECT 'd' || doc_id AS key, text AS answer FROM documents UNION ALL SELECT 'a' || answer_id, answer FROM {values('answers')})",
    "recent_turns": f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS back FROM {values('turns')}) SELECT conversation_id, turn, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS place, {truncated('content', 1200)} AS content FROM r WHERE back <= 3",
    "web_contexts": f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY tier, position) AS nth FROM {values('web_tiers')}), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, position) AS place FROM o WHERE nth = 1) SELECT query_id, '## Web Search Results' || chr(10) || chr(10) || 'Query: ' || chr(34) || any_value(query) || chr(34) || chr(10) || chr(10) || chr(10) || chr(10) || string_agg('[Web ' || place || '] **' || title || '**' || chr(10) || snippet || chr(10) || 'Source: ' || url, chr(10) || chr(10) ORDER BY place) AS context FROM p WHERE place <= 5 GROUP BY query_id",
    "dedupe_best_rank": f"{BM25_CHUNKS}, {RANKED} SELECT * FROM ranked",
    "retrieval_quality": f"{BM25_CHUNKS}, {RANKED}, {QRELS} SELECT query_id, relevant, round(recall, 9) AS recall, round(precision, 9) AS precision, round(reciprocal_rank, 9) AS reciprocal_rank, round(ndcg, 9) AS ndcg, hit FROM {quality(5)}",
    "quality_summary": f"{BM25_CHUNKS}, {RANKED}, {QRELS} SELECT round(avg(a.recall), 6) AS recall_at_5, round(avg(b.recall), 6) AS recall_at_10, round(avg(a.precision), 6) AS precision_at_5, round(avg(a.reciprocal_rank), 6) AS mrr, round(avg(a.ndcg), 6) AS ndcg_at_5, round(avg(a.hit::INTEGER), 6) AS hit_rate, count(*) AS queries FROM {quality(5)} a JOIN {quality(10)} b USING (query_id)",
    "stride_sample": "WITH c AS (SELECT query_id, language, row_number() OVER (ORDER BY query_id) - 1 AS i, count(*) OVER () AS n FROM evaluation_cases) SELECT query_id, language FROM c WHERE n <= 25 OR i IN (SELECT floor(j * c.n / 25.0) FROM range(0, 25) t(j))",
    "stage_stats": f"WITH {LOG}, {_LONG} {percentiles('long', 'ms', 'stage')}",
    "latency_percentiles": percentiles("events", "value", "event_type"),
    "throughput_hourly": f"WITH {LOG} SELECT strftime({_UTC}, '%Y-%m-%dT%H:00') AS hour, count(*) AS requests, round(avg({measured('total_latency_ms')}), 4) AS average_ms FROM log WHERE {_AT} IS NOT NULL GROUP BY 1",
    "analytics_snapshot": f"WITH {LOG} SELECT count(*) AS total_requests, count(*) FILTER (status = 'answered') AS answered, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status IN ('low_confidence', 'insufficient_context')) AS low_confidence, count(*) FILTER (status IN ('failed', 'error')) AS failed, round(coalesce(avg({measured('total_latency_ms')}), 0), 4) AS average_ms, round(coalesce(avg(confidence) FILTER (NOT isnan(confidence)), 0), 4) AS average_confidence, coalesce(sum(tokens_used), 0)::BIGINT AS tokens_used, count(*) FILTER (voice) AS voice_requests FROM log",
    "recent_requests": f"WITH {LOG} SELECT recency, request_id, status FROM (SELECT row_number() OVER (ORDER BY {_AT} DESC NULLS LAST, request_id DESC) AS recency, request_id, status FROM log) WHERE recency <= 1000",
    "rate_limits": f"WITH {LOG} SELECT {_QID} AS client, strftime({_UTC}, '%Y-%m-%dT%H:%M') AS minute, count(*) AS requests, greatest(0, count(*) - 60) AS general_refused, greatest(0, count(*) - 20) AS query_refused, greatest(0, count(*) - 12) AS voice_refused FROM log WHERE {_AT} IS NOT NULL GROUP BY 1, 2",
    "budget_verdicts": f"WITH {LOG}, {_LONG}, st AS ({percentiles('long', 'ms', 'stage')}) SELECT stage, round(greatest(p100, 50.0) * 1.05, 4) AS peak, p100 <= 50.0 AS within, concat_ws(',', CASE WHEN p50 > 50 THEN 'p50' END, CASE WHEN p70 > 50 THEN 'p70' END, CASE WHEN p95 > 50 THEN 'p95' END, CASE WHEN p99 > 50 THEN 'p99' END, CASE WHEN p100 > 50 THEN 'p100' END) AS breaches FROM st",
    "latest_vs_median": f"WITH {LOG}, v AS (SELECT coalesce(status, 'none') AS status, round({measured('total')}, 2) AS v, {_AT} AS t, request_id FROM log) SELECT status, arg_max(v, {{'t': t, 'r': request_id}}) AS latest, list_sort(list(v))[(count(*) // 2 + 1)::BIGINT] AS upper_median FROM v WHERE v IS NOT NULL GROUP BY status",
    "guardrail_rules": "WITH r AS (SELECT 'd' || doc_id AS key, text AS query FROM documents UNION ALL SELECT key, query FROM " + values("prompts") + ") " + " UNION ALL ".join(f"SELECT key, '{r.name}' AS rule FROM r WHERE {_rule('query', r.pattern)}" for r in RULES),
    "guardrail_verdicts": f"WITH {_REPORT} SELECT key, guard, score, verdict, evidence FROM judged",
    "guardrail_reports": f"WITH {_REPORT}, m AS (SELECT key, bool_or(verdict = 'block') AS blocked, arg_min(guard, position) FILTER (verdict = 'block') AS blocked_by FROM judged GROUP BY key) SELECT key, blocked, blocked_by, CASE WHEN blocked THEN {_REFUSED} END AS refusal FROM m",
    "guardrail_events": f"WITH {_REPORT} SELECT guard, count(*) AS events FROM judged WHERE verdict <> 'pass' GROUP BY guard",
    "latest_guardrails": f"SELECT key, guard, arg_max(verdict, seq) AS verdict, arg_max(score, seq) AS score FROM {values('staged_results')} GROUP BY 1, 2",
    "evidence_guardrails": f"""{EVIDENCE}
        SELECT query_id, chunks, round(top, 6) AS top_score, round(mean, 6) AS mean_score, round(agreement, 6) AS agreement, round(coverage, 6) AS coverage, round(least(1.0, hint * 0.6 + (1 - coverage) * 0.4), 6) AS off_topic_score, round(verification, 6) AS verification_score,
        CASE WHEN chunks = 0 OR top < 0.28 THEN 'block' ELSE 'pass' END AS similarity_verdict, CASE WHEN hint >= 0.6 AND coverage < 0.25 THEN 'warn' ELSE 'pass' END AS off_topic_verdict, CASE WHEN verification < 0.25 THEN 'warn' ELSE 'pass' END AS verification_verdict FROM l""",
    "confidence_blend": f"SELECT key, round({BLEND}, 4) AS confidence, round({BLEND}, 12) >= 0.42 AS sufficient, list_max([{LOSSES}]).f AS worst, CASE WHEN trim(coalesce(answer, '')) = '' OR contains(answer, 'I couldn''t find enough evidence in the retrieved documents.') THEN 'insufficient_context' WHEN round({BLEND}, 12) < 0.42 THEN 'low_confidence' ELSE 'answered' END AS status, CASE WHEN trim(coalesce(answer, '')) = '' OR contains(answer, 'I couldn''t find enough evidence in the retrieved documents.') THEN 'I couldn''t find enough evidence in the retrieved documents.' WHEN round({BLEND}, 12) < 0.42 THEN 'I don''t have enough information.' ELSE {strip('answer')} END AS final, round(0.55 * ({clamp('groundedness')}), 6) AS unverified FROM {values('signals')}",
    "score_clamps": f"SELECT n, round({clamp('x')}, 9) AS clamped, round(CASE WHEN coalesce(x, 0) >= 0 OR isnan(x) THEN 1 / (1 + exp(-coalesce(x, 0))) ELSE exp(x) / (1 + exp(x)) END, 9) AS sigmoid FROM {values('numbers')}",
    "web_results": f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY tier, position) AS nth FROM {values('web_tiers')}), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, position) AS place FROM o WHERE nth = 1) SELECT query_id, place, url, title FROM p WHERE place <= 5",
    "cases_from_index": f"WITH {CHUNKS}, s AS (SELECT * FROM chunk_rows WHERE is_selected AND coalesce(query_id, '') <> '') SELECT query_id, arg_min(coalesce(query_text, topic, ''), id) AS query, arg_min(language, id) AS language, array_to_string(list_sort(list_distinct(list(document_id))), ',') AS expected FROM s GROUP BY query_id HAVING {strip('arg_min(coalesce(query_text, topic, ' + chr(39) * 2 + '), id)')} <> ''",
    "suggestions": f"WITH {CHUNKS}, {_SUGGEST} SELECT * FROM sug",
    "suggestion_pairs": f"WITH {CHUNKS}, {_SUGGEST} SELECT a.query_id, a.text AS english, b.language, b.text FROM sug a JOIN sug b USING (query_id) WHERE a.language = 'eng_Latn' AND b.language <> 'eng_Latn'",
    "language_quota": "WITH d AS (SELECT DISTINCT document_id, language FROM source_documents), f AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY document_id) AS nth FROM d) SELECT document_id, language FROM f WHERE nth <= 10 ORDER BY nth, language LIMIT 100",
    "upsert_latest": "SELECT id, arg_max(is_parent, upserted_at) AS is_parent, epoch_us(max(upserted_at)) AS upserted_us FROM vector_records GROUP BY id",
    "index_stats": f"WITH {CHUNKS} SELECT count(*) AS vectors, count(DISTINCT document_id) AS documents, count(*) FILTER (strategy <> 'parent') AS chunks, count(*) FILTER (strategy = 'parent') AS parents, floor(avg(length(text)) FILTER (strategy <> 'parent') + 0.5)::INTEGER AS average_chars, floor(avg(token_count) FILTER (strategy <> 'parent') + 0.5)::INTEGER AS average_tokens, max(indexed_at) AS last_indexed_at FROM chunk_rows",
    "index_counts": f"WITH {CHUNKS}, k AS (SELECT 'language' AS kind, language AS value, text, token_count FROM chunk_rows UNION ALL SELECT 'strategy', strategy, text, token_count FROM chunk_rows) SELECT kind, value, count(*) AS chunks, floor(avg(length(text)) + 0.5)::BIGINT AS average_chars, floor(avg(token_count) + 0.5)::BIGINT AS average_tokens FROM k GROUP BY 1, 2",
    "dataset_totals": "SELECT language, count(*) AS passages, count(*) FILTER (is_selected) AS selected FROM (SELECT DISTINCT ON (document_id) * FROM source_documents) GROUP BY language",
    "grouped_parents": f"WITH {CHUNKS} SELECT id, document_id FROM chunk_rows WHERE id IN (SELECT parent_chunk FROM chunk_rows WHERE parent_chunk IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)",
    "new_windows": f"WITH {CHUNKS} SELECT id FROM chunk_rows w WHERE strategy = 'sliding_window' AND NOT EXISTS (SELECT 1 FROM chunk_rows c WHERE c.strategy <> 'sliding_window' AND c.document_id = w.document_id AND c.passage_id = w.passage_id AND c.text = w.text)",
    "request_batches": "SELECT query_id, ((row_number() OVER (ORDER BY query_id) - 1) // 16)::BIGINT AS batch FROM evaluation_cases",
    "form_booleans": f"WITH f AS (SELECT n, lower(trim(value)) AS v FROM {values('fields')}) SELECT n, CASE WHEN coalesce(v, '') = '' THEN TRUE ELSE v NOT IN ('false', '0', 'no', 'off', 'null', 'undefined') END AS \"on\", CASE WHEN coalesce(v, '') = '' THEN FALSE ELSE v NOT IN ('false', '0', 'no', 'off', 'null', 'undefined') END AS off FROM f",
    "request_validation": f"SELECT n, coalesce(top_k, 10) AS top_k, coalesce(top_n, 5) AS top_n, concat_ws(',', CASE WHEN length(trim(coalesce(query, ''))) < 2 THEN 'query_too_short' END, CASE WHEN length(trim(query)) > 2000 THEN 'query_too_long' END, CASE WHEN top_k NOT BETWEEN 1 AND 50 THEN 'top_k' END, CASE WHEN top_n NOT BETWEEN 1 AND 20 THEN 'top_n' END, CASE WHEN history > 20 THEN 'history' END) AS problems FROM {values('form_requests')}",
    "health_status": f"SELECT CASE WHEN bool_or(status = 'down') THEN 'down' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'up' END AS status, CASE WHEN bool_or(status = 'down') THEN 503 ELSE 200 END AS code FROM {values('services')}",
}

ORACLES |= CHUNKING
