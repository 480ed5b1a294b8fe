"""Chunking again as DuckDB SQL: sentences by running lengths, splits by marked separators, sequential steps as folds over lists."""

from __future__ import annotations

# Fixed values, held here again apart from the operators': a wrong one shows.
DENSE_SCRIPTS = "Devanagari Bengali Tamil Telugu Kannada Malayalam Gujarati Gurmukhi Oriya Arabic Han Hiragana Katakana".split()
STOPWORDS = (
    "a an the and or but if then than so because as of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further once here there when where why how all any both each few more most other some such no nor "
    "not only own same too very can will just should now is are was were be been being have has had having do does did doing would could shall "
    "may might must i you he she it we they me him her them my your his its our their this that these those what which who whom whose"
).split()
SCRIPTS = "Latin Devanagari Bengali Tamil Telugu Kannada Malayalam Gujarati Gurmukhi Oriya Arabic".split()
LANGUAGE_NAMES = {
    "eng_Latn": "English", "asm_Beng": "Assamese", "ben_Beng": "Bengali", "brx_Deva": "Bodo", "doi_Deva": "Dogri", "gom_Deva": "Konkani", "guj_Gujr": "Gujarati", "hin_Deva": "Hindi",
    "kan_Knda": "Kannada", "kas_Arab": "Kashmiri", "mai_Deva": "Maithili", "mal_Mlym": "Malayalam", "mar_Deva": "Marathi", "mni_Beng": "Manipuri", "npi_Deva": "Nepali", "ory_Orya": "Odia",
    "pan_Guru": "Punjabi", "san_Deva": "Sanskrit", "sat_Olck": "Santali", "snd_Arab": "Sindhi", "tam_Taml": "Tamil", "tel_Telu": "Telugu", "urd_Arab": "Urdu",
}
TARGET, LEAST, OVERLAP, PARENT, WINDOW, STRIDE = 220, 48, 48, 700, 160, 80

SP = r"[\p{Z}\t\n\x0B\f\r\x{0085}\x{FEFF}]"
_ENDS = ".!?。！？…॥।؟۔"
_PIECES = f"[^{_ENDS}]*[{_ENDS}]+[{_ENDS}\"''”’)\\]]*|[^{_ENDS}]+$"
_MARKED = (  # separators from coarse to fine, with what stays before them
    (r"()(\n{2,})"), (r"()(\n)"), (r"([.!?।॥۔؟…])(" + SP + "+)"), (r"([;:])(" + SP + "+)"), (r"(,)(" + SP + "+)"), ("()(" + SP + "+)"),
)


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SP}+|{SP}+$', '', 'g')"


def estimate(t: str) -> str:
    not_dense = "[^" + "".join(rf"\p{{{s}}}" for s in DENSE_SCRIPTS) + "]"
    return f"CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE greatest(1, ceil(length({t}) / (4.0 - 1.4 * length(regexp_replace({t}, '{not_dense}', '', 'g')) / length({t}))))::INTEGER END"


def normal(t: str) -> str:
    for a, b in ((r"[\x{200B}-\x{200D}\x{FEFF}]", "''"), (r"\r\n?", "chr(10)"), (r"[ \t]+", "' '"), (r"\n{3,}", "chr(10) || chr(10)")):
        t = f"regexp_replace({t}, '{a}', {b}, 'g')"
    return strip(t)


def sentences(source: str, out: str = "sent") -> str:
    """CTEs up to ``out``(k, i from 1, n, t, s, e, tok) of the texts of source(k, t)."""
    return f"""
    {out}_p AS (SELECT k, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (SELECT k, regexp_extract_all(t, '{_PIECES}') AS ps FROM {source})),
    {out}_o AS (SELECT k, i, p, sum(length(p)) OVER (PARTITION BY k ORDER BY i) AS e FROM {out}_p),
    {out}_f AS (SELECT k, i, {strip('p')} AS p, (e - length(p))::INTEGER AS s, e::INTEGER AS e FROM {out}_o WHERE {strip('p')} <> ''),
    {out}_g AS (SELECT *, sum(CASE WHEN {estimate('p')} >= 4 OR nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS nth FROM {out}_f)),
    {out}_m AS (SELECT k, g::INTEGER AS i, string_agg(p, ' ' ORDER BY i) AS t, min(s) AS s, max(e) AS e FROM {out}_g GROUP BY k, g),
    {out} AS MATERIALIZED (SELECT *, {estimate('t')} AS tok, count(*) OVER (PARTITION BY k) AS n FROM {out}_m)"""


def merged(source: str, out: str) -> str:
    """CTE ``out``(k, i, t, s, e, tok): small neighbours of source(k, i, t, s, e) merged."""
    near = f"least(acc[-1].tok, x[1].tok) < {LEAST} AND acc[-1].tok + x[1].tok <= {TARGET} * 1.35"
    both = strip("acc[-1].t || ' ' || x[1].t")
    one = f"{{'t': {both}, 's': acc[-1].s, 'e': x[1].e, 'tok': {estimate(both)}}}"
    return f"""
    {out}_l AS (SELECT k, list([{{'t': t, 's': s::INTEGER, 'e': e::INTEGER, 'tok': {estimate('t')}}}] ORDER BY s) AS l FROM {source} GROUP BY k),
    {out}_r AS (SELECT k, list_reduce(l, lambda acc, x: CASE WHEN {near} THEN list_concat(list_slice(acc, 1, len(acc) - 1), [{one}]) ELSE list_concat(acc, x) END) AS l FROM {out}_l),
    {out} AS MATERIALIZED (SELECT k, unnest(range(1, len(l) + 1))::INTEGER AS i, unnest(l, recursive := true) FROM {out}_r)"""


def structural(source: str, out: str) -> str:
    """CTEs up to ``out``(k, i, t, s, e, tok): source(k, t) split by ever finer separators."""
    steps = [f"{out}_0 AS (SELECT k, t AS whole, 0 AS a, length(t)::INTEGER AS b FROM {source} WHERE t <> '')"]
    for n, pattern in enumerate(_MARKED):
        part = "substring(whole, a + 1, b - a)"
        steps.append(f"""
    {out}_d{n} AS (SELECT *, {estimate(part)} > {TARGET} AS large FROM {out}_{n}),
    {out}_s{n} AS (SELECT k, whole, a, b, unnest(range(1, len(ps) + 1)) AS j, unnest(ps) AS p FROM (SELECT *, string_split(regexp_replace({part}, '{pattern}', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)) AS ps FROM {out}_d{n} WHERE large)),
    {out}_t{n} AS (SELECT *, CASE WHEN j = 1 THEN 0 ELSE instr(p, chr(2)) - 1 END AS gap, CASE WHEN j = 1 THEN p ELSE substring(p, instr(p, chr(2)) + 1) END AS body FROM {out}_s{n}),
    {out}_u{n} AS (SELECT *, (a + sum(gap + length(body)) OVER (PARTITION BY k, a, b ORDER BY j) - length(body))::INTEGER AS x FROM {out}_t{n}),
    {out}_v{n} AS (SELECT *, count(*) OVER (PARTITION BY k, a, b) AS parts FROM {out}_u{n} WHERE {strip('body')} <> ''),
    {out}_{n + 1} AS (SELECT k, whole, a, b FROM {out}_d{n} WHERE NOT large UNION ALL SELECT DISTINCT k, whole, CASE WHEN parts > 1 THEN x ELSE a END AS a, (CASE WHEN parts > 1 THEN x + length(body) ELSE b END)::INTEGER AS b FROM {out}_v{n})""")
    last = f"{out}_{len(_MARKED)}"
    body = "substring(whole, a + 1, b - a)"
    lead = f"length({body}) - length(regexp_replace({body}, '^{SP}+', ''))"
    steps.append(f"{out}_e AS (SELECT k, {strip(body)} AS t, (a + {lead})::INTEGER AS s, (a + {lead} + length({strip(body)}))::INTEGER AS e FROM {last} WHERE {strip(body)} <> '')")
    steps.append(merged(f"{out}_e", out))
    return ", ".join(steps)


def topical(sent: str, out: str) -> str:
    """CTEs up to ``out``(k, i, t, s, e, tok): sentences grouped where their words differ most."""
    words = r"list_distinct(list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}\p{M}]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOPWORDS) + "], w)))"
    both, either = "len(list_intersect(a, b))", "len(list_distinct(list_concat(a, b)))"
    closed = lambda tok, row: f"{row}.last OR (({tok} >= {TARGET} OR {row}.far) AND {tok} >= {LEAST})"
    size = "CASE WHEN acc[-1].closed THEN 0 ELSE acc[-1].size END + x[1].size"
    return f"""
    {out}_w AS (SELECT *, {words} AS w FROM {sent}),
    {out}_n AS (SELECT *, list_distinct(list_concat(w, coalesce(lag(w) OVER o, []))) AS a, list_distinct(list_concat(lead(w) OVER o, coalesce(lead(w, 2) OVER o, []))) AS b FROM {out}_w WINDOW o AS (PARTITION BY k ORDER BY i)),
    {out}_d AS (SELECT *, CASE WHEN i < n THEN 1 - CASE WHEN len(a) > 0 AND len(b) > 0 THEN {both}::DOUBLE / {either} ELSE 0.0 END END AS d FROM {out}_n),
    {out}_q AS (SELECT k, CASE WHEN count(d) = 0 THEN 1.0 ELSE list(d ORDER BY d)[greatest(1, ceil(88 / 100 * count(d))::BIGINT)] END AS brk FROM {out}_d GROUP BY k),
    {out}_x AS (SELECT d.k, d.i, d.t, d.s, d.e, d.n, {{'i': d.i, 'size': d.tok, 'last': d.i = d.n, 'far': coalesce(d.i < d.n AND d.d >= brk, FALSE), 'grp': 0, 'closed': FALSE}} AS r FROM {out}_d d JOIN {out}_q USING (k)),
    {out}_y AS (SELECT k, list([{{'i': r.i, 'size': r.size, 'last': r.last, 'far': r.far, 'grp': 0, 'closed': {closed('r.size', 'r')}}}] ORDER BY i) AS l FROM {out}_x GROUP BY k),
    {out}_z AS (SELECT k, unnest(list_reduce(l, lambda acc, x: list_concat(acc, [{{'i': x[1].i, 'size': {size}, 'last': x[1].last, 'far': x[1].far, 'grp': acc[-1].grp + CASE WHEN acc[-1].closed THEN 1 ELSE 0 END, 'closed': {closed('(' + size + ')', 'x[1]')}}}])), recursive := true) FROM {out}_y),
    {out}_h AS (SELECT x.k, grp, string_agg(t, ' ' ORDER BY x.i) AS t, min(s) AS s, max(e) AS e, any_value(n) AS n FROM {out}_x x JOIN {out}_z z ON x.k = z.k AND x.i = z.i GROUP BY x.k, grp),
    {merged(f"{out}_h", out)}"""


def overlapped(spans: str, texts: str, out: str) -> str:
    """CTEs up to ``out``(k, i, t, s, e, tok): each of spans(k, i, t, s, e) but the first begins with the end of the one before."""
    half = lambda x: f"floor({x} + 0.5)::INTEGER"
    return f"""
    {out}_b AS (SELECT sp.*, tx.t AS whole, lag(sp.s) OVER o AS ps, lag(sp.e) OVER o AS pe FROM {spans} sp JOIN {texts} tx USING (k) WINDOW o AS (PARTITION BY k ORDER BY i)),
    {out}_c AS (SELECT *, CASE WHEN ps IS NULL THEN 0 ELSE least({half(f"{OVERLAP} * length(whole) / {estimate('whole')}::DOUBLE")}, {half('(e - s) * 0.35::DOUBLE')}, {half('(pe - ps) * 0.5::DOUBLE')}) END AS reach FROM {out}_b),
    {out}_a AS (SELECT *, greatest(ps, s - reach) AS at0 FROM {out}_c),
    {out}_l AS (SELECT *, greatest(at0 - 24, 0) AS lo FROM {out}_a),
    {out}_k AS (SELECT *, CASE WHEN at0 <= 0 OR at0 >= length(whole) THEN at0 ELSE at0 - length(regexp_extract(substring(whole, lo + 2, at0 - lo), '[^{SP[1:]}*$')) END AS cut_at FROM {out}_l),
    {out}_j AS (SELECT k, i, CASE WHEN reach <= 0 THEN t WHEN {strip('substring(whole, cut_at + 1, e - cut_at)')} = '' THEN t ELSE {strip('substring(whole, cut_at + 1, e - cut_at)')} END AS t, CASE WHEN reach <= 0 THEN s ELSE cut_at END::INTEGER AS s, e::INTEGER AS e FROM {out}_k),
    {out} AS MATERIALIZED (SELECT *, {estimate('t')} AS tok FROM {out}_j)"""


def parents(spans: str, texts: str, out: str) -> str:
    """CTEs up to ``out``_of(k, i, grp) and ``out``(k, i from 1, t, s, e, tok, n): runs of spans up to the parent size, and their children."""
    full = f"acc[-1].size > 0 AND acc[-1].size + x[1].size > {PARENT}"
    return f"""
    {out}_l AS (SELECT k, list([{{'i': i, 'size': tok::BIGINT, 'grp': 1}}] ORDER BY i) AS l FROM {spans} GROUP BY k),
    {out}_of AS MATERIALIZED (SELECT k, unnest(list_reduce(l, lambda acc, x: list_concat(acc, [{{'i': x[1].i, 'size': CASE WHEN {full} THEN x[1].size ELSE acc[-1].size + x[1].size END, 'grp': acc[-1].grp + CASE WHEN {full} THEN 1 ELSE 0 END}}])), recursive := true) FROM {out}_l),
    {out}_g AS (SELECT sp.k, grp, arg_min(s, i) AS s, arg_max(e, i) AS e, count(*) AS n FROM {spans} sp JOIN {out}_of o USING (k, i) GROUP BY ALL),
    {out}_t AS (SELECT g.k, grp AS i, {strip('substring(tx.t, s + 1, e - s)')} AS t, s, e, n FROM {out}_g g JOIN {texts} tx ON tx.k = g.k),
    {out} AS MATERIALIZED (SELECT *, {estimate('t')} AS tok FROM {out}_t)"""


def sliding(sent: str, out: str) -> str:
    """CTEs up to ``out``(k, i from 1, t, s, e, tok): windows over sentences, each a stride on. The WITH must be RECURSIVE."""
    return f"""
    {out}_c AS MATERIALIZED (SELECT *, sum(tok) OVER (PARTITION BY k ORDER BY i) AS upto FROM {sent}),
    {out}_n AS MATERIALIZED (SELECT a.k, a.i AS first, a.n, max(b.i) FILTER (b.i = a.i OR b.upto - a.upto + a.tok <= {WINDOW}) AS last, greatest(a.i + 1, coalesce(min(b.i) FILTER (b.upto - a.upto + a.tok >= {STRIDE}), a.n) + 1) AS next FROM {out}_c a JOIN {out}_c b ON a.k = b.k AND b.i >= a.i GROUP BY a.k, a.i, a.n),
    {out}_r AS (SELECT k, first, last, next, n, 1 AS i FROM {out}_n WHERE first = 1 UNION ALL SELECT x.k, x.first, x.last, x.next, x.n, r.i + 1 FROM {out}_r r JOIN {out}_n x ON x.k = r.k AND x.first = r.next WHERE r.last < r.n),
    {out}_w AS (SELECT r.k, r.i, string_agg(c.t, ' ' ORDER BY c.i) AS t, min(c.s) AS s, max(c.e) AS e FROM {out}_r r JOIN {out}_c c ON c.k = r.k AND c.i BETWEEN r.first AND r.last GROUP BY r.k, r.i),
    {out} AS MATERIALIZED (SELECT *, {estimate('t')} AS tok FROM {out}_w)"""


TEXTS = f"texts AS MATERIALIZED (SELECT k, t FROM (SELECT document_id AS k, {normal(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS t FROM (SELECT DISTINCT ON (document_id) * FROM source_documents)) WHERE t <> '')"
_SPANS = "SELECT k AS document_id, (i - 1)::INTEGER AS span, s::INTEGER AS char_start, e::INTEGER AS char_end, tok::INTEGER AS token_count FROM"


def uuid(key: str) -> str:
    h = f"sha1({key})"
    return f"substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-5' || substring({h}, 14, 3) || '-' || substring('89ab', (('0x' || substring({h}, 17, 1))::INTEGER % 4) + 1, 1) || substring({h}, 18, 3) || '-' || substring({h}, 21, 12)"


def _pipeline() -> str:
    key = lambda strategy, index: f"d.document_id || '::' || d.passage_id || '::' || {strategy} || '::' || {index}"
    child = "CASE WHEN total > 1 THEN 'overlap' WHEN few THEN 'recursive' ELSE 'semantic' END"
    return f"""
    WITH RECURSIVE docs AS MATERIALIZED (SELECT DISTINCT ON (document_id) document_id, passage_id FROM source_documents), {TEXTS}, {sentences('texts')},
    counted AS (SELECT t.k, t.t, coalesce(max(n), 0) < 3 AS few FROM texts t LEFT JOIN sent s ON s.k = t.k GROUP BY ALL),
    short AS (SELECT k, t FROM counted WHERE few), {structural('short', 'st')},
    long AS (SELECT s.* FROM sent s JOIN counted c ON c.k = s.k AND NOT few), {topical('long', 'tp')},
    huge AS (SELECT k || chr(31) || i AS k, t FROM tp WHERE tok > {TARGET} * 1.5), {structural('huge', 'hg')},
    base_rows AS (
        SELECT k, t, s, e FROM st UNION ALL SELECT k, t, s, e FROM tp WHERE NOT tok > {TARGET} * 1.5
        UNION ALL SELECT tp.k, hg.t, tp.s + hg.s, least(tp.e, tp.s + hg.e) FROM hg JOIN tp ON hg.k = tp.k || chr(31) || tp.i),
    base AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY s, e) AS i, t, s, e, count(*) OVER (PARTITION BY k) AS total FROM base_rows),
    {overlapped('base', 'texts', 'ov')}, {parents('ov', 'texts', 'pa')}, {sliding('sent', 'sl')},
    par AS (SELECT {key("'parent'", '(i - 1)')} AS key, pa.*, d.document_id FROM pa JOIN docs d ON d.document_id = pa.k WHERE n > 1),
    chi AS (SELECT {key(child, '(ov.i - 1)')} AS key, {child} AS strategy, ov.*, grp, d.document_id FROM ov JOIN docs d ON d.document_id = ov.k JOIN counted c ON c.k = ov.k JOIN base b ON b.k = ov.k AND b.i = ov.i JOIN pa_of o ON o.k = ov.k AND o.i = ov.i),
    win AS (SELECT {key("'sliding_window'", '(sl.i - 1)')} AS key, sl.*, d.document_id FROM sl JOIN texts x ON x.k = sl.k JOIN docs d ON d.document_id = sl.k
        WHERE {estimate('x.t')} > 2 * {WINDOW} AND NOT EXISTS (FROM par WHERE par.k = sl.k AND par.t = sl.t) AND NOT EXISTS (FROM chi WHERE chi.k = sl.k AND chi.t = sl.t)),
    rows AS (
        SELECT key, document_id, 'parent' AS strategy, i, NULL AS parent_key, tok, s, e FROM par
        UNION ALL SELECT c.key, c.document_id, strategy, c.i, p.key, c.tok, c.s, c.e FROM chi c LEFT JOIN par p ON p.k = c.k AND p.i = c.grp
        UNION ALL SELECT key, document_id, 'sliding_window', i, NULL, tok, s, e FROM win)
    SELECT {uuid('key')} AS id, document_id, strategy, (i - 1)::INTEGER AS chunk_index, CASE WHEN parent_key IS NOT NULL THEN {uuid('parent_key')} END AS parent_chunk, tok::INTEGER AS token_count, s::INTEGER AS char_start, e::INTEGER AS char_end FROM rows"""


CHUNKING: dict[str, str] = {
    "rough_sentences": f"WITH texts AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents), {sentences('texts')} SELECT k AS doc_id, s AS char_start, e AS char_end, md5(t) AS digest FROM sent",
    "recursive_chunk": f"WITH {TEXTS}, {structural('texts', 'st')} {_SPANS} st",
    "semantic_chunk": f"WITH {TEXTS}, {sentences('texts')}, {topical('sent', 'tp')} {_SPANS} tp",
    "sliding_window": f"WITH RECURSIVE {TEXTS}, {sentences('texts')}, {sliding('sent', 'sl')} {_SPANS} sl",
    "overlap_chunk": f"WITH {TEXTS}, {sentences('texts')}, {topical('sent', 'tp')}, {overlapped('tp', 'texts', 'ov')} {_SPANS} ov",
    "parent_chunk": f"WITH {TEXTS}, {sentences('texts')}, {topical('sent', 'tp')}, {overlapped('tp', 'texts', 'ov')}, {parents('ov', 'texts', 'pa')} {_SPANS} pa",
    "chunk_pipeline": _pipeline(),
}
