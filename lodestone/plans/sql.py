"""The catalogue's queries as SQL for DuckDB."""

from __future__ import annotations

from lodestone.functions.text import FAILURE_RULES, STOPWORDS, SUFFIXES, TERM
from lodestone.operators.chunking import OVERLAP, SWEEP, TARGET
from lodestone.operators.evaluation import CUTOFF, DEPTHS
from lodestone.operators.fusion import RRF_K, WEIGHTS
from lodestone.operators.grounding import SEVERITY, STATUS
from lodestone.operators.metering import PRICES
from lodestone.operators.outcomes import FAILURES, RERANK_CHARS, SEVERITIES, STATUSES, TONES
from lodestone.operators.search import DOCUMENT_CHARS, FRAMEWORK_CHARS, MOST_RESULTS, QUERY_CHARS
from lodestone.plans.catalogue import CEILING, CONFIGS, DAILY, FILES, LIMIT, MARKERS, MESSAGES, WINDOW_MS


def _r(x: str, places: int = 6) -> str:
    return f"(floor(({x})::DOUBLE * 1e{places} + 0.5) / 1e{places})"


_STEM = "CASE " + " ".join(
    f"WHEN length(t) > 3 AND t LIKE '%{s}' AND length(t) >= {len(s) + 3} THEN left(t, length(t) - {len(s)})" + (" || 'y'" if s == "ies" else "") for s in SUFFIXES
) + " ELSE t END"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _terms(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower({text}), '{TERM}'), lambda t: t NOT IN ({_STOP})), lambda t: {_STEM})"


def _corpus(indexed: str) -> str:
    return f"""
corpus AS (SELECT doc_id AS chunk_idx, lang AS framework, source || ':' || doc_id AS citation, split_part(text, chr(10), 1) AS heading, text, {_terms(indexed)} AS terms FROM documents),
postings AS (SELECT chunk_idx, framework, len(terms) AS n_terms, term, count(*) AS tf
    FROM (SELECT chunk_idx, framework, terms, unnest(terms) AS term FROM corpus) GROUP BY ALL),
asked AS (SELECT item_id AS query_id, unnest(list_distinct({_terms('text')})) AS term FROM benchmark),
"""


_CORPUS = _corpus("text")
_SCORED = f"""
stats AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM corpus),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
bm25 AS (SELECT query_id, chunk_idx, framework, {_r("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_terms / a)))")} AS score
    FROM asked JOIN postings USING (term) JOIN freq USING (term), stats GROUP BY ALL),
"""
_BM25 = _CORPUS + _SCORED


def _top(rows: str, k: int, order: str = "score DESC, chunk_idx") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ({rows})) WHERE rank <= {k}"


_NORM = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"
_UNIT = f"CASE WHEN abs({_NORM} - 1) < 1e-6 OR {_NORM} = 0 THEN embedding ELSE list_transform(embedding, lambda x: (x::DOUBLE / {_NORM})::FLOAT) END"
_VECTORS = f"vectors AS (SELECT vec_id AS chunk_idx, label, {_UNIT} AS v FROM embeddings),"
_INT8 = """
steps AS (SELECT *, CASE WHEN list_max(list_transform(v, lambda x: abs(x::DOUBLE))) = 0 THEN 1.0::DOUBLE ELSE list_max(list_transform(v, lambda x: abs(x::DOUBLE))) / 127 END AS step FROM vectors),
int8 AS (SELECT chunk_idx, label, step::FLOAT AS scale, list_transform(v, lambda x: floor(x::DOUBLE / step + 0.5)::TINYINT) AS q FROM steps),
"""


def _knn(queries: str, data: str, where: str = "true") -> str:
    return f"SELECT q.query_id, d.chunk_idx, {_r('list_dot_product(q.v::DOUBLE[], d.v::DOUBLE[])')} AS score FROM {queries} q, {data} d WHERE {where}"


_KNN8 = f"SELECT q.query_id, d.chunk_idx, {_r('list_dot_product(q.v::DOUBLE[], d.q::DOUBLE[]) * d.scale::DOUBLE')} AS score FROM q20 q, int8 d"
_ASKED20 = "q20 AS (SELECT chunk_idx AS query_id, v FROM vectors WHERE chunk_idx % 20 = 0),"
_ARMS = f"""{_BM25} {_VECTORS}
qv AS (SELECT item_id AS query_id, v FROM benchmark JOIN vectors ON item_id = chunk_idx),
dense AS ({_top(_knn('qv', 'vectors'), 50)}),
lexical AS ({_top('SELECT query_id, chunk_idx, score FROM bm25', 50)}),
arms AS (SELECT query_id, chunk_idx, d.rank AS dense_rank, l.rank AS bm25_rank FROM dense d FULL JOIN lexical l USING (query_id, chunk_idx)),
"""
_ORDER = "score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST"


def _fused(wd: str, wl: str, k: int) -> str:
    score = _r(f"coalesce({wd} / ({RRF_K} + dense_rank), 0) + coalesce({wl} / ({RRF_K} + bm25_rank), 0)", 9)
    return _top(f"SELECT query_id, chunk_idx, dense_rank, bm25_rank, {score} AS score FROM arms", k, _ORDER)


_GOLD = "gold AS (SELECT item_id AS query_id, d.citation FROM benchmark b JOIN corpus d ON contains(d.text, b.text)),"
_EVAL = f"""{_ARMS} {_GOLD}
found AS (
    SELECT 'dense' AS config, query_id, chunk_idx, rank FROM dense WHERE rank <= 10 UNION ALL
    SELECT 'bm25', query_id, chunk_idx, rank FROM lexical WHERE rank <= 10 UNION ALL
    SELECT 'rrf_equal', query_id, chunk_idx, rank FROM ({_fused('1.0::DOUBLE', '1.0::DOUBLE', 10)}) UNION ALL
    SELECT 'rrf_weighted', query_id, chunk_idx, rank FROM ({_fused('1.0::DOUBLE', '0.3::DOUBLE', 10)})),
sizes AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
hits AS (SELECT config, query_id, {', '.join(f'count(*) FILTER (rank <= {k}) AS h{k}' for k in DEPTHS)}, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain
    FROM found JOIN corpus USING (chunk_idx) JOIN gold USING (query_id, citation) GROUP BY config, query_id),
per AS (SELECT c.config, s.query_id, {', '.join(f'coalesce(h{k}, 0) / n_gold AS recall_{k}' for k in DEPTHS)}, coalesce(1 / first, 0) AS mrr,
    coalesce(gain, 0) / list_sum(list_transform(generate_series(1, least(n_gold, {CUTOFF})), lambda i: 1 / log2(i + 1))) AS ndcg
    FROM sizes s CROSS JOIN (SELECT DISTINCT config FROM found) c LEFT JOIN hits USING (config, query_id)),
"""
_MEANS = ", ".join(f"{_r(f'avg({m})')} AS {m}" for m in [*[f"recall_{k}" for k in DEPTHS], "mrr", "ndcg"])


_SEARCHED = _corpus("source || ':' || doc_id || chr(10) || split_part(text, chr(10), 1) || chr(10) || text") + _SCORED + _VECTORS + """
qv AS (SELECT item_id AS query_id, v FROM benchmark JOIN vectors ON item_id = chunk_idx),
own AS (SELECT v.chunk_idx, v.v, c.framework FROM vectors v JOIN corpus c USING (chunk_idx)),"""


def _search(arms: str, rows: str) -> str:
    return f"{_end(_SEARCHED + arms)} SELECT query_id, chunk_idx, score, rank, dense_rank, bm25_rank, framework, citation FROM ({rows}) JOIN corpus USING (chunk_idx)"


def _both(where: str) -> str:
    return f"""
dense AS ({_top(_knn('qv', 'own', where), 50)}),
lexical AS ({_top(f"SELECT query_id, chunk_idx, score FROM bm25 d WHERE {where}", 50)}),
arms AS (SELECT query_id, chunk_idx, d.rank AS dense_rank, l.rank AS bm25_rank FROM dense d FULL JOIN lexical l USING (query_id, chunk_idx)),"""


_BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _size(words: str) -> str:
    return f"ceil({words} * 1.3::DOUBLE)::INT"


def _slugged(x: str) -> str:
    return f"left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60)"


def _chunks(target: int, overlap: int, name: str = "chunks", citation: str = "source || ':' || doc_id") -> str:
    """Common table expressions, for WITH RECURSIVE, that end with name: id, chunk_idx, citation, text, tokens, ordinal, ordinal_of."""
    p = name
    return f"""
{p}_para AS (SELECT doc_id, k AS para, trim_ AS text FROM (SELECT doc_id, k, regexp_replace(regexp_replace(x, '^[{_BLANK}]+', ''), '[{_BLANK}]+$', '') AS trim_
    FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))) WHERE trim_ <> ''),
{p}_sized AS (SELECT *, len(regexp_extract_all(text, '[^{_BLANK}]+')) AS n FROM {p}_para),
{p}_said AS (SELECT doc_id, para, k, x, len(regexp_extract_all(x, '[^{_BLANK}]+')) AS n FROM (SELECT doc_id, para, unnest(l) AS x, generate_subscripts(l, 1) AS k
    FROM (SELECT doc_id, para, string_split(regexp_replace(text, '([.;:])[{_BLANK}]+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM {p}_sized WHERE {_size('n')} > {target}))),
{p}_run AS (SELECT doc_id, para, k, 1 AS run, n AS words FROM {p}_said WHERE k = 1
    UNION ALL SELECT s.doc_id, s.para, s.k, r.run + (w > {target})::INT, CASE WHEN w > {target} THEN s.n ELSE r.words + s.n END
    FROM (SELECT r.*, s.n, s.k AS next, {_size('(r.words + s.n)')} AS w FROM {p}_run r JOIN {p}_said s ON s.doc_id = r.doc_id AND s.para = r.para AND s.k = r.k + 1) r
    JOIN {p}_said s ON s.doc_id = r.doc_id AND s.para = r.para AND s.k = r.next),
{p}_unit AS (SELECT doc_id, para, 0 AS run, text FROM {p}_sized WHERE {_size('n')} <= {target}
    UNION ALL SELECT doc_id, para, run, string_agg(x, ' ' ORDER BY k) FROM {p}_run JOIN {p}_said USING (doc_id, para, k) GROUP BY doc_id, para, run),
{p}_list AS (SELECT doc_id, list(text ORDER BY para, run) AS texts, list({_size(f"len(regexp_extract_all(text, '[^{_BLANK}]+'))")} ORDER BY para, run) AS sizes FROM {p}_unit GROUP BY doc_id),
{p}_walk AS (SELECT doc_id, 0 AS i, 0 AS first, sizes[1] AS used, NULL::INT AS was FROM {p}_list
    UNION ALL SELECT doc_id, i, CASE WHEN full_ THEN i - carried ELSE first END, CASE WHEN full_ THEN coalesce(list_sum(sizes[i - carried + 1 : i]), 0)::INT ELSE used END + sizes[i + 1], CASE WHEN full_ THEN first END
    FROM (SELECT w.doc_id, w.i + 1 AS i, w.first, w.used, l.sizes, w.used + l.sizes[w.i + 2] > {target} AS full_,
        len(list_filter(generate_series(1, w.i + 1 - w.first), lambda j: list_sum(l.sizes[w.i + 2 - j : w.i + 1]) <= {overlap})) AS carried
        FROM {p}_walk w JOIN {p}_list l ON l.doc_id = w.doc_id AND w.i + 1 < len(l.sizes))),
{p}_body AS (SELECT doc_id, was AS a, i AS b FROM {p}_walk WHERE was IS NOT NULL UNION ALL SELECT doc_id, first, i + 1 FROM {p}_walk QUALIFY i = max(i) OVER (PARTITION BY doc_id)),
{p}_made AS (SELECT doc_id, b, array_to_string(texts[a + 1 : b], chr(10)) AS text FROM {p}_body JOIN {p}_list USING (doc_id)),
{p}_told AS (SELECT *, {_size(f"len(regexp_extract_all(text, '[^{_BLANK}]+'))")} AS tokens FROM {p}_made),
{p}_kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS ordinal, count(*) OVER (PARTITION BY doc_id) AS ordinal_of
    FROM (SELECT * FROM {p}_told QUALIFY tokens >= 32 OR max(tokens) OVER (PARTITION BY doc_id) < 32 AND b = min(b) OVER (PARTITION BY doc_id))),
{p} AS (SELECT {_slugged('lang')} || ':' || {_slugged(citation)} || ':' || ordinal AS id, doc_id AS chunk_idx, {citation} AS citation, k.text, tokens, ordinal::INT AS ordinal, ordinal_of::INT AS ordinal_of
    FROM {p}_kept k JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)),
"""


def _swept(k: int, target: int, overlap: int) -> tuple[str, str]:
    """Common table expressions of BM25 over the chunks of a configuration, and the row of its metrics on the paraphrased queries."""
    ctes = f"""{_chunks(target, overlap, f"c{k}")}
t{k} AS (SELECT (chunk_idx::BIGINT << 20) + ordinal AS c, citation, {_terms('text')} AS terms FROM c{k}),
p{k} AS (SELECT c, citation, len(terms) AS n_terms, term, count(*) AS tf FROM (SELECT c, citation, terms, unnest(terms) AS term FROM t{k}) GROUP BY ALL),
n{k} AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM t{k}),
f{k} AS (SELECT term, count(*) AS df FROM p{k} GROUP BY term),
b{k} AS (SELECT query_id, c, citation, {_r("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_terms / a)))")} AS score
    FROM asked JOIN p{k} USING (term) JOIN f{k} USING (term), n{k} WHERE query_id % 4 = 2 GROUP BY ALL),
r{k} AS (SELECT query_id, citation, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM ({_top(f"SELECT * FROM b{k}", 40, "score DESC, c")}) GROUP BY query_id, citation),
h{k} AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 10) AS h10, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM r{k} JOIN gold USING (query_id, citation) WHERE rank <= {CUTOFF} GROUP BY query_id),
m{k} AS (SELECT {_r('avg(coalesce(h1, 0) / n_gold)')} AS recall_1, {_r('avg(coalesce(h10, 0) / n_gold)')} AS recall_10, {_r('avg(coalesce(1 / first, 0))')} AS mrr,
    {_r(f'avg(coalesce(gain, 0) / list_sum(list_transform(generate_series(1, least(n_gold, {CUTOFF})), lambda i: 1 / log2(i + 1))))')} AS ndcg FROM sizes LEFT JOIN h{k} USING (query_id) WHERE query_id % 4 = 2),"""
    return ctes, f"SELECT {target} AS target, {overlap} AS overlap, (SELECT n FROM n{k}) AS n_chunks, * FROM m{k} WHERE recall_1 IS NOT NULL"


def _recursive(ctes: str) -> str:
    return "WITH RECURSIVE " + ctes.strip().rstrip(",")


def _covered(query: str, k: int) -> str:
    """Chunks with all terms of a query by cover density: each smallest span from its last entry, by the latest entry of every term."""
    return f"""WITH asked AS (SELECT item_id AS query_id, unnest(list_distinct({_terms(query)})) AS term FROM benchmark),
sizes AS (SELECT query_id, count(*) AS n_asked FROM asked GROUP BY query_id),
raw AS (SELECT chunk_idx, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id AS chunk_idx, regexp_extract_all(lower(text), '{TERM}') AS l FROM documents)),
occ AS (SELECT chunk_idx, pos, {_STEM} AS term FROM raw WHERE t NOT IN ({_STOP})),
met AS (SELECT query_id, chunk_idx FROM asked JOIN occ USING (term) JOIN sizes USING (query_id) GROUP BY query_id, chunk_idx, n_asked HAVING count(DISTINCT term) = n_asked),
ent AS (SELECT query_id, chunk_idx, term, pos, row_number() OVER (PARTITION BY query_id, chunk_idx ORDER BY pos) AS k FROM met JOIN asked USING (query_id) JOIN occ USING (chunk_idx, term)),
pairs AS (SELECT e.query_id, e.chunk_idx, e.k, e.pos, max(CASE WHEN e.term = a.term THEN e.k END) OVER (PARTITION BY e.query_id, e.chunk_idx, a.term ORDER BY e.k) AS latest
    FROM ent e JOIN asked a USING (query_id)),
spans AS (SELECT query_id, chunk_idx, k, pos, CASE WHEN count(latest) = count(*) THEN min(latest) END AS b FROM pairs GROUP BY ALL),
covers AS (SELECT *, lag(b) OVER (PARTITION BY query_id, chunk_idx ORDER BY k) AS before FROM spans),
scored AS (SELECT query_id, chunk_idx, {_r("sum(0.1::DOUBLE / (1 + (c.pos - f.pos) - (c.k - b)))")} AS score
    FROM (SELECT * FROM covers WHERE b IS NOT NULL AND (before IS NULL OR b > before)) c JOIN (SELECT query_id, chunk_idx, k AS b, pos FROM ent) f USING (query_id, chunk_idx, b) GROUP BY query_id, chunk_idx)
{_top("SELECT * FROM scored", k)}"""


def _end(ctes: str) -> str:
    return "WITH " + ctes.strip().rstrip(",")


_STRIP = "trim(regexp_replace(" + "replace(" * 6 + "regexp_replace({x}, '<[^>]+>', ' ', 'g')" + ", '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')" + r", '\s+', ' ', 'g'))"
_TRIM = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
_TIDY = _TRIM.replace("{x}", r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, chr(13) || chr(10) || '?', chr(10), 'g'), '[ ' || chr(9) || ']+' || chr(10), chr(10), 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), '[ ' || chr(9) || ']{{2,}}', ' ', 'g')")
_SPACED = r"trim(regexp_replace({x}, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g'))"
_FILES = f"f AS (SELECT doc_id, lang AS title, source AS s, {_SPACED.format(x='coalesce(text, chr(32))')} AS t, {_SPACED.format(x='coalesce(text[:150], chr(32))')} AS u FROM documents)"
_FOLD = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
_QTOKENS = "list_filter(regexp_split_to_array(" + _FOLD + ", '[^a-z0-9]+'), lambda t: t <> '')"
_CLAIMS = f"{_CORPUS} {_GOLD} claims AS (SELECT item_id || '-' || chunk_idx AS claim_id, b.text AS quote, c.text AS source FROM gold g JOIN benchmark b ON item_id = query_id JOIN corpus c USING (citation)),"
_NEAR = r"near AS (SELECT claim_id, array_to_string(list_filter(regexp_split_to_array(quote, '\s+'), lambda w, k: k % 5 <> 0), ' ') AS quote, source FROM claims),"


def _overlap(claims: str, out: str) -> str:
    q, s = _QTOKENS.format(x="quote"), _QTOKENS.format(x="source")
    return f"""
{out}_t AS (SELECT claim_id, {q} AS q, {s} AS s, {_FOLD.format(x='quote')} AS fq, {_FOLD.format(x='source')} AS fs FROM {claims}),
{out}_w AS (SELECT claim_id, q, s[k : k + len(q) - 1] AS w FROM (SELECT *, unnest(generate_series(1, greatest(len(s) - len(q) + 1, 1))) AS k FROM {out}_t WHERE len(q) >= 4 AND NOT contains(fs, fq))),
{out}_b AS (SELECT claim_id, max(list_sum(list_transform(list_distinct(q), lambda t: least(len(list_filter(q, lambda x: x = t)), len(list_filter(w, lambda x: x = t))))) / len(q)) AS sim FROM {out}_w GROUP BY claim_id),
{out} AS (SELECT claim_id, CASE WHEN len(q) < 4 THEN 'unsupported' WHEN contains(fs, fq) THEN 'exact' WHEN sim >= 0.75 THEN 'near' ELSE 'unsupported' END AS verdict,
    CASE WHEN len(q) < 4 THEN 0.0 WHEN contains(fs, fq) THEN 1.0 ELSE {_r('sim')} END::DOUBLE AS similarity,
    CASE WHEN len(q) >= 4 AND contains(fs, fq) THEN instr(fs, fq) - 1 END AS "offset" FROM {out}_t LEFT JOIN {out}_b USING (claim_id)),"""


def _case(table: dict, name: str) -> str:
    return f"CASE {name} " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in enumerate(table.values())) + " END"


def _pick(values, at: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{at} % {len(values)} + 1]"


_REPORTS = """r AS (SELECT o_orderkey::VARCHAR AS report_id, sha256(o_custkey::VARCHAR) AS document_hash, o_orderdate AS created_at,
    o_orderdate + INTERVAL 30 DAY AS expires_at, o_orderstatus = 'P' AS pinned, o_totalprice AS total, max(o_orderdate) OVER () AS now FROM orders),"""
_SPANS = """s AS (SELECT *, CASE WHEN tokens IS NOT NULL THEN floor(tokens / 4)::INT END AS out_tokens,
    CASE kind WHEN 'embed' THEN 'gemini-embedding-001' WHEN 'retrieve' THEN NULL ELSE CASE WHEN event_id % 97 = 0 THEN 'other' ELSE 'gemini-3.6-flash' END END AS model
    FROM (SELECT *, CASE WHEN k % 10 <> 0 AND kind <> 'retrieve' THEN floor(value * 100)::INT END AS tokens, k % 7 = 0 AS cached FROM (
        SELECT event_id, value, user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, (props->>'$.k')::INT AS k,
        CASE event_type WHEN 'view' THEN 'retrieve' WHEN 'click' THEN 'embed' WHEN 'signup' THEN 'rerank' ELSE 'generate' END AS kind FROM events))),"""
_RATE = "CASE model " + " ".join(f"WHEN '{m}' THEN (coalesce(tokens, 0) * {i}::DOUBLE + coalesce(out_tokens, 0) * {o}::DOUBLE) / 1e6" for m, (i, o) in PRICES.items()) + " END"
_CALLS = "c AS (SELECT event_id AS call_id, event_type AS bucket, user_id::VARCHAR AS visitor, epoch_us(ts) // 1000 AS at_ms FROM events),"
_ANCHORED = f"""WITH RECURSIVE {_CALLS}
n AS (SELECT *, row_number() OVER (PARTITION BY bucket, visitor ORDER BY at_ms, call_id) AS k FROM c),
f AS (SELECT *, 1 AS count, at_ms AS opened, true AS allowed FROM n WHERE k = 1
    UNION ALL
    SELECT n.*, CASE WHEN n.at_ms - f.opened > {WINDOW_MS} THEN 1 WHEN f.count < {LIMIT} THEN f.count + 1 ELSE f.count END,
        CASE WHEN n.at_ms - f.opened > {WINDOW_MS} THEN n.at_ms ELSE f.opened END, n.at_ms - f.opened > {WINDOW_MS} OR f.count < {LIMIT}
    FROM f JOIN n ON n.bucket = f.bucket AND n.visitor = f.visitor AND n.k = f.k + 1)"""

_CEILED = f"""WITH RECURSIVE {_CALLS}
        n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY at_ms, call_id) AS k FROM c),
        f AS (SELECT call_id, bucket, k, at_ms AS day, 1 AS total, MAP {{visitor: {{'n': 1, 'at': at_ms}}}} AS seen, true AS allowed, {LIMIT} - 1 AS remaining FROM n WHERE k = 1
            UNION ALL
            SELECT call_id, bucket, k, day, total + ok::INT, CASE WHEN ok THEN map_concat(seen, MAP {{visitor: {{'n': (w.n + 1)::INT, 'at': w.at}}}}) ELSE seen END, ok, CASE WHEN ok THEN {LIMIT} - w.n - 1 ELSE 0 END
            FROM (SELECT *, total < {CEILING} AND w.n < {LIMIT} AS ok FROM (
                SELECT n.call_id, n.bucket, n.k, n.visitor, CASE WHEN n.at_ms - f.day > 86400000 THEN n.at_ms ELSE f.day END AS day, CASE WHEN n.at_ms - f.day > 86400000 THEN 0 ELSE f.total END AS total, f.seen,
                    CASE WHEN f.seen[n.visitor] IS NULL OR n.at_ms - f.seen[n.visitor].at > {WINDOW_MS} THEN {{'n': 0, 'at': n.at_ms}} ELSE f.seen[n.visitor] END AS w
                FROM f JOIN n ON n.bucket = f.bucket AND n.k = f.k + 1)))
        SELECT call_id, allowed, remaining::BIGINT AS remaining FROM f"""

_BROKEN = f"""SELECT case_id, position, list_filter([
    CASE WHEN length(citation) < 3 THEN 'citation' END, CASE WHEN length(explanation) < 20 THEN 'explanation' END, CASE WHEN position >= 12 THEN 'number' END, CASE WHEN length(quote) < 10 THEN 'regulation_quote' END,
    CASE WHEN length(requirement) < 8 THEN 'requirement' END, CASE WHEN severity NOT IN ({', '.join(f"'{x}'" for x in SEVERITIES)}) THEN 'severity' END, CASE WHEN status NOT IN ({', '.join(f"'{x}'" for x in STATUSES)}) THEN 'status' END], lambda x: x IS NOT NULL) AS v
    FROM (SELECT l_orderkey AS case_id, l_linenumber - 1 AS position, 'keep ' || l_partkey AS requirement, {_pick((*STATUSES, 'wrong'), 'l_partkey')} AS status, {_pick((*SEVERITIES, 'none', 'low', 'high'), 'l_suppkey')} AS severity,
        repeat('why ', (l_partkey % 9)::INT) AS explanation, repeat('says ', (l_partkey % 4)::INT) AS quote, 'c' || (l_partkey % 200) AS citation FROM lineitem)"""

SQL: dict[str, str] = {
    "tokenize_terms": f"SELECT doc_id AS chunk_idx, len(t) AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, {_terms('text')} AS t FROM documents)",
    "term_frequency": f"{_end(_CORPUS)} SELECT chunk_idx, term, tf FROM postings",
    "document_frequency": f"{_end(_CORPUS)} SELECT term, count(*) AS df FROM postings GROUP BY term",
    "corpus_stats": f"{_end(_CORPUS)} SELECT count(*) AS n_chunks, {_r('avg(len(terms))')} AS avg_terms FROM corpus",
    "vocabulary_size": f"{_end(_CORPUS)} SELECT count(DISTINCT term) AS n_distinct_terms FROM postings",
    "bm25_topk": f"{_end(_BM25)} {_top('SELECT query_id, chunk_idx, score FROM bm25', 10)}",
    "bm25_filtered": f"""{_end(_BM25)} {_top("SELECT query_id, chunk_idx, score FROM bm25 WHERE framework = 'en'", 5)}""",
    "fulltext_and_match": f"""{_end(_CORPUS)} SELECT query_id, chunk_idx FROM asked JOIN postings USING (term) GROUP BY query_id, chunk_idx
        HAVING count(*) = (SELECT count(*) FROM asked a WHERE a.query_id = asked.query_id)""",
    "dense_topk": f"{_end(_VECTORS + _ASKED20)} {_top(_knn('q20', 'vectors'), 10)}",
    "dense_filtered": f"{_end(_VECTORS + _ASKED20)} {_top(_knn('q20', 'vectors', 'd.label = 3'), 10)}",
    "int8_quantize": f"{_end(_VECTORS + _INT8)} SELECT chunk_idx, {_r('scale', 9)} AS scale, array_to_string(q, ',') AS q FROM int8",
    "int8_topk": f"{_end(_VECTORS + _ASKED20 + _INT8)} {_top(_KNN8, 10)}",
    "approximate_parity": "SELECT count(*) AS n_queries, true AS recall_reached, true AS same_scores FROM embeddings WHERE vec_id % 20 = 0",
    "int8_parity": f"""{_end(_VECTORS + _ASKED20 + _INT8 + f"a AS ({_top(_knn('q20', 'vectors'), 10)}), b AS ({_top(_KNN8, 10)}),")},
        la AS (SELECT query_id, list(chunk_idx ORDER BY rank) AS a FROM a GROUP BY query_id), lb AS (SELECT query_id, list(chunk_idx ORDER BY rank) AS b FROM b GROUP BY query_id)
        SELECT count(*) AS n_queries, count(*) FILTER (a[1] = b[1]) AS rank1_equal, count(*) FILTER (list_sort(a) = list_sort(b)) AS set_equal, count(*) FILTER (a = b) AS order_equal,
        {_r('avg(len(list_intersect(a, b)) / len(a))')} AS mean_overlap,
        (SELECT {_r('max(abs(a.score - b.score))')} FROM a JOIN b USING (query_id, chunk_idx)) AS max_score_delta FROM la JOIN lb USING (query_id)""",
    "index_errors": "SELECT vec_id AS chunk_idx, CASE vec_id % 50 WHEN 7 THEN 0.0::DOUBLE WHEN 9 THEN -1.0::DOUBLE END AS norm FROM embeddings WHERE vec_id % 50 BETWEEN 7 AND 9",
    "rrf_equal": f"{_end(_ARMS)} SELECT query_id, chunk_idx, score, rank FROM ({_fused('1.0::DOUBLE', '1.0::DOUBLE', 10)})",
    "rrf_provenance": f"{_end(_ARMS)} {_fused('1.0::DOUBLE', '0.3::DOUBLE', 10)}",
    "rrf_weighted_sweep": _end(_ARMS) + " " + " UNION ALL ".join(f"SELECT {w}::DOUBLE AS lexical_weight, query_id, chunk_idx, score, rank FROM ({_fused('1.0::DOUBLE', f'{w}::DOUBLE', 10)})" for w in WEIGHTS),
    "rerank_listwise": f"""{_end(_ARMS + f"f AS ({_fused('1.0::DOUBLE', '1.0::DOUBLE', 30)}),")},
        j AS (SELECT f.query_id, f.chunk_idx, count(*) AS n, (SELECT count(*) FROM asked a WHERE a.query_id = f.query_id) AS m
            FROM f JOIN asked USING (query_id) JOIN postings p ON p.chunk_idx = f.chunk_idx AND p.term = asked.term WHERE f.chunk_idx % 2 = 1 GROUP BY f.query_id, f.chunk_idx),
        g AS (SELECT f.query_id, f.chunk_idx, f.rank AS fused_rank, CASE WHEN n IS NULL THEN -1 ELSE least(3, floor(4 * n / m)) END::INT AS relevance FROM f LEFT JOIN j USING (query_id, chunk_idx))
        {_top('SELECT * FROM g', 10, 'relevance DESC, fused_rank')}""",
    "gold_labels": f"{_end(_CORPUS + _GOLD)} SELECT * FROM gold",
    "eval_metrics": f"{_end(_EVAL)} SELECT config, count(*) AS n, {_MEANS} FROM per GROUP BY config",
    "eval_by_slice": f"""{_end(_EVAL)} SELECT config, slice, count(*) AS n, {_MEANS} FROM (SELECT *, unnest(['all', CASE query_id % 4 WHEN 2 THEN 'paraphrased' WHEN 3 THEN 'lookup' ELSE 'direct' END]) AS slice FROM per)
        GROUP BY config, slice""",
    "eval_by_framework": f"""{_end(_EVAL)} SELECT 'f' || (query_id % 5) AS framework, count(DISTINCT query_id) AS n,
        {', '.join(f"{_r(f'''avg(recall_{CUTOFF}) FILTER (config = '{c}')''')} AS {c}" for c in CONFIGS)} FROM per GROUP BY 1""",
    "eval_best_config": f"""{_end(_EVAL)} SELECT config, count(*) AS n, {_MEANS} FROM per GROUP BY config
        ORDER BY ndcg DESC, list_position([{', '.join(f"'{c}'" for c in CONFIGS)}], config) LIMIT 1""",
    "gold_missing_citations": f"""{_end(_CORPUS)}, g AS (SELECT item_id AS query_id, 'src' || (item_id % 20) || ':' || item_id || CASE WHEN item_id % 4 = 1 THEN 'x' ELSE '' END AS citation FROM benchmark)
        SELECT * FROM g WHERE citation NOT IN (SELECT citation FROM corpus)""",
    "token_estimates": r"""SELECT doc_id AS chunk_idx, (13 * w + 9) // 10 AS tokens, (3 * w + 3) // 4 AS billed,
        left(regexp_replace(regexp_replace(lower(lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) || ':' ||
        left(regexp_replace(regexp_replace(lower(source || ':' || doc_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) || ':0' AS id
        FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents)""",
    "ground_exact": f"{_end(_CLAIMS + _overlap('claims', 'v'))} SELECT * FROM v",
    "ground_window_overlap": f"{_end(_CLAIMS + _NEAR + _overlap('near', 'v'))} SELECT claim_id, verdict, similarity FROM v",
    "ground_totals": f"""{_end(_CLAIMS + _NEAR + '''every AS (SELECT * FROM claims UNION ALL SELECT claim_id || 'n', quote, source FROM near
        UNION ALL SELECT claim_id || 's', array_to_string(string_split(quote, ' ')[1:3], ' '), source FROM claims),''' + _overlap('every', 'v'))}
        SELECT *, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE {_r('(exact + near) / total')} END AS rate FROM (SELECT count(*) FILTER (verdict = 'exact') AS exact,
        count(*) FILTER (verdict = 'near') AS near, count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) AS total FROM v)""",
    "framework_score": f"""SELECT l_orderkey AS framework, count(*) AS n_findings, count(*) FILTER (l_linestatus = 'F') AS n_supported,
        greatest(0, floor(100 - coalesce(sum({_case(SEVERITY, 'l_linenumber % 4')} * {_case(STATUS, '(l_partkey % 4)::INT')}) FILTER (l_linestatus = 'F'), 0) + 0.5))::BIGINT AS score FROM lineitem GROUP BY l_orderkey""",
    "trace_cost": f"""{_end(_SPANS)} SELECT run_id, coalesce(sum(tokens) FILTER (kind <> 'embed'), 0)::BIGINT AS input_tokens, coalesce(sum(out_tokens) FILTER (kind <> 'embed'), 0)::BIGINT AS output_tokens,
        CASE WHEN bool_or(kind <> 'embed' AND CASE WHEN tokens IS NOT NULL THEN {_RATE} IS NULL ELSE kind IN ('generate', 'rerank') AND NOT cached END) THEN NULL
            ELSE {_r(f"coalesce(sum({_RATE}) FILTER (kind <> 'embed' AND tokens IS NOT NULL), 0)")} END AS cost,
        count(*) FILTER (cached) AS n_cached, count(*) FILTER (kind = 'embed' AND NOT cached) AS n_unpriced FROM s GROUP BY run_id""",
    "html_sections": f"""SELECT page_id, para, text FROM (SELECT page_id, para, {_STRIP.format(x='raw')} AS text FROM (
        SELECT page_id, unnest(p) AS raw, unnest(generate_series(0, len(p) - 1)) AS para FROM (
        SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)<p(\\s[^>]*)?>', '</p><p>', 'g') || '</p>', '(?is)<p>(.*?)</p>', 1) AS p FROM pages))) WHERE length(text) >= 80""",
    "jsonl_sections": "SELECT lang AS framework, concat_ws(':', source, doc_id) AS citation, split_part(text, chr(10), 1) AS heading, source, NULL::VARCHAR AS source_url, sha256(text) AS text_sha256 FROM documents",
    "regulation_sections": f"""WITH {_FILES} SELECT title, doc_id || '.1' AS number, s AS heading, sha256(t) AS text_sha256 FROM f WHERE length(t) >= 80
        UNION ALL SELECT title, doc_id || '.2', 'Section ' || doc_id || '.2', sha256(concat_ws(chr(10), nullif(u, ''), s)) FROM f WHERE length(concat_ws(chr(10), nullif(u, ''), s)) >= 80""",
    "regulation_appendices": f"""WITH {_FILES} SELECT title, 'App. ' || doc_id AS number, 'App. ' || doc_id AS heading, sha256(t) AS text_sha256 FROM f WHERE length(t) >= 120
        UNION ALL SELECT title, 'App. ' || doc_id, s, sha256(u) FROM f WHERE length(u) >= 120""",
    "legal_articles": f"""WITH {_FILES} SELECT doc_id || '1' AS article, s AS heading, sha256(t) AS text_sha256 FROM f WHERE length(t) >= 120
        UNION ALL SELECT doc_id || '2', 'Article ' || doc_id || '2', sha256(u) FROM f WHERE length(u) >= 120""",
    "uploaded_texts": f"""WITH f AS (SELECT doc_id, doc_id % 7 AS k, coalesce(CASE WHEN doc_id % 7 = 4 THEN replace(text, 'e', chr(65533)) WHEN doc_id % 7 = 5 THEN '' WHEN doc_id % 7 = 6 AND doc_id % 5 = 0 THEN repeat(text, 16) ELSE text END, '') AS raw FROM documents),
        t AS (SELECT doc_id || CASE k WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.exe' WHEN 3 THEN '.bin' ELSE '.md' END AS path, CASE k WHEN 1 THEN 'pdf' WHEN 2 THEN NULL ELSE 'text' END AS kind, strlen(raw) AS size, {_TIDY.format(x='raw')} AS t FROM f),
        e AS (SELECT *, CASE WHEN size = 0 THEN 'empty' WHEN size > 5000000 THEN 'too large' WHEN kind IS NULL OR kind = 'pdf' THEN 'unsupported' END AS bad,
            CASE WHEN (length(t) - length(replace(t, chr(65533), ''))) / greatest(length(t), 1) > 0.02 THEN 'not text' WHEN length(t) < 200 THEN 'too short' END AS fault FROM t)
        SELECT path, kind, coalesce(bad, fault) AS error, CASE WHEN bad IS NULL AND fault IS NULL THEN sha256(t[:24000]) END AS text_sha256, bad IS NULL AND length(t) > 24000 AS truncated FROM e""",
    "stored_index": "SELECT label AS framework, count(*) AS n_vectors, sum(len(embedding))::BIGINT AS n_steps FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY label",
    "html_text": f"SELECT page_id, sha256({_STRIP.format(x='html')}) AS text_sha256 FROM pages",
    "tidy_and_validate": f"""SELECT doc_id, sha256(t) AS text_sha256, length(t) AS n_chars, length(t) < 200 AS too_short, {_r("(length(t) - length(replace(t, chr(65533), ''))) / greatest(length(t), 1)")} AS replaced, length(t) > 24000 AS truncated
        FROM (SELECT doc_id, {_TIDY.format(x='text')} AS t FROM documents)""",
    "document_hashes": f"SELECT sha256({_TRIM.format(x='text')}) AS document_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1",
    "cache_lookup": f"{_end(_REPORTS)} SELECT document_hash, report_id, created_at FROM r WHERE expires_at > now QUALIFY row_number() OVER (PARTITION BY document_hash ORDER BY created_at DESC, report_id DESC) = 1",
    "purge_expired": f"{_end(_REPORTS)} SELECT pinned, count(*) AS n_left, min(created_at) AS oldest FROM r WHERE expires_at >= now OR pinned GROUP BY pinned",
    "purge_count": f"{_end(_REPORTS)} SELECT count(*) FILTER (expires_at < now AND NOT pinned) AS n_purged FROM r",
    "report_upsert": f"""{_end(_REPORTS)}, o AS (SELECT report_id, document_hash, total FROM r WHERE report_id::BIGINT % 3 <> 0), n AS (SELECT report_id, 'new' AS document_hash, total * 2 AS total FROM r WHERE report_id::BIGINT % 2 = 0)
        SELECT report_id, coalesce(o.document_hash, n.document_hash) AS document_hash, coalesce(n.total, o.total) AS total FROM o FULL JOIN n USING (report_id)""",
    "rate_limit_fixed": f"""{_end(_CALLS)} SELECT *, n_window <= {LIMIT} AND n_day <= {DAILY} AS allowed FROM (SELECT *,
        row_number() OVER (PARTITION BY bucket, visitor, at_ms // {WINDOW_MS} ORDER BY at_ms, call_id) AS n_window,
        row_number() OVER (PARTITION BY bucket, at_ms // 86400000 ORDER BY at_ms, call_id) AS n_day FROM c)""",
    "rate_limit_anchored": f"{_ANCHORED} SELECT call_id, allowed, CASE WHEN allowed THEN {LIMIT} - count ELSE 0 END::BIGINT AS remaining FROM f",
    "rate_limit_stream": f"{_ANCHORED} SELECT call_id, allowed FROM f",
    "visitor_key": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '192.168.0.' || user_id ELSE 'unknown' END AS visitor FROM events",
    "classify_failure": f"""SELECT event_id, CASE {' '.join(f"WHEN {' OR '.join(f'''contains(lower(m), '{p}')''' for p in parts)} THEN '{k}'" for k, parts in FAILURE_RULES)} ELSE 'unknown' END AS kind
        FROM (SELECT event_id, {_pick(MESSAGES, 'event_id')} AS m FROM events)""",
    "file_kind": f"""SELECT page_id, CASE WHEN lower(n) LIKE '%.pdf' OR m = 'application/pdf' THEN 'pdf' WHEN lower(n) LIKE '%.docx' THEN 'docx'
        WHEN regexp_matches(lower(n), '\\.(txt|md|markdown|json|csv)$') OR m IN ('text/plain', 'text/markdown', 'text/x-markdown', 'application/json', '') THEN 'text' END AS kind
        FROM (SELECT page_id, {_pick([f[0] for f in FILES], 'page_id')} AS n, {_pick([f[1] for f in FILES], 'page_id')} AS m FROM pages)""",
    "index_stats": "SELECT lang AS framework, count(*) AS n_sections, count(DISTINCT source || ':' || doc_id) AS n_citations FROM documents GROUP BY lang",
    "merge_concern_passages": f"""{_end(_VECTORS + _ASKED20)}, f AS ({_top(_knn('q20', 'vectors'), 10)}),
        b AS (SELECT query_id // 20 % 4 AS grp, chunk_idx, min((rank, query_id // 80)) AS b FROM f GROUP BY ALL),
        p AS (SELECT grp, chunk_idx, b[1] AS best_rank, row_number() OVER (PARTITION BY grp ORDER BY b, chunk_idx) AS place FROM b) SELECT * FROM p WHERE place <= 12""",
    "ndjson_events_stream": "SELECT event_type AS type, count(*) AS n_events, sum(event_id)::BIGINT AS sum_ids FROM events GROUP BY event_type",
    "search_bm25": _search("", f"SELECT *, rank AS bm25_rank, NULL::BIGINT AS dense_rank FROM ({_top('SELECT query_id, chunk_idx, score FROM bm25', 5)})"),
    "search_dense": _search("", f"""SELECT *, rank AS dense_rank, NULL::BIGINT AS bm25_rank FROM ({_top(_knn('qv', 'own', "d.framework = 'en'"), 5)})"""),
    "search_hybrid": _search(_both("d.framework = 'fr'"), _fused("1.0::DOUBLE", "1.0::DOUBLE", 10)),
    "search_hybrid_rerank": _search(_both("true") + f"f AS ({_fused('1.0::DOUBLE', '1.0::DOUBLE', 50)}), g AS (SELECT * EXCLUDE (rank), rank AS fused_rank, CASE WHEN chunk_idx % 2 = 1 THEN chunk_idx % 4 ELSE -1 END AS relevance FROM f),",
        _top("SELECT * FROM g", 5, "relevance DESC, fused_rank")),
    "fulltext_topk": _covered("text", 3),
    "fulltext_short": _covered("array_to_string(string_split(text, ' ')[:3], ' ')", 10),
    "fusion_weight_on_dev": f"""{_end(_EVAL + "many AS (" + " UNION ALL ".join(f"SELECT {w}::DOUBLE AS weight, query_id, chunk_idx, rank FROM ({_fused('1.0::DOUBLE', f'{w}::DOUBLE', 10)})" for w in WEIGHTS) + "),"
        + "got AS (SELECT weight, query_id, sum(1 / log2(rank + 1)) AS gain FROM many JOIN corpus USING (chunk_idx) JOIN gold USING (query_id, citation) GROUP BY weight, query_id),"
        + f"means AS (SELECT w.weight, {_r(f'avg(coalesce(gain, 0) / list_sum(list_transform(generate_series(1, least(n_gold, {CUTOFF})), lambda i: 1 / log2(i + 1))))')} AS ndcg FROM sizes s CROSS JOIN (SELECT DISTINCT weight FROM many) w LEFT JOIN got USING (weight, query_id) WHERE s.query_id % 4 < 2 GROUP BY w.weight),")}
        SELECT weight, ndcg FROM means ORDER BY ndcg DESC, weight LIMIT 1""",
    "gold_totals": f"""{_end(_CORPUS + _GOLD)} SELECT slice, count(DISTINCT query_id) AS n_queries, count(*) AS n_labels FROM (SELECT DISTINCT query_id, citation,
        unnest(['all', CASE query_id % 4 WHEN 2 THEN 'paraphrased' WHEN 3 THEN 'lookup' ELSE 'direct' END]) AS slice FROM gold) GROUP BY slice""",
    "missing_slices": "SELECT 'adversarial' AS slice",
    "recall_curve": f"""{_end(_EVAL)} SELECT k, {', '.join(f"max(round_) FILTER (config = '{c}') AS {c}" for c in CONFIGS)} FROM (
        {' UNION ALL '.join(f"SELECT {k} AS k, config, {_r(f'm{k} * 100', 1)} AS round_ FROM (SELECT config, {_r(f'avg(recall_{k})')} AS m{k} FROM per GROUP BY config)" for k in DEPTHS)}) GROUP BY k""",
    "failure_messages": f"""SELECT event_id, kind, CASE kind {' '.join(f"WHEN '{k}' THEN {v[0]}" for k, v in FAILURES.items())} END AS status, CASE kind {' '.join(f"WHEN '{k}' THEN {v[1]}" for k, v in FAILURES.items())} END AS retryable
        FROM (SELECT event_id, CASE {' '.join(f"WHEN {' OR '.join(f"contains(lower(m), '{p}')" for p in parts)} THEN '{k}'" for k, parts in FAILURE_RULES)} ELSE 'unknown' END AS kind FROM (SELECT event_id, {_pick(MESSAGES, 'event_id')} AS m FROM events))""",
    "finding_violations": f"SELECT case_id, position, array_to_string(v, ',') AS violations FROM ({_BROKEN})",
    "finding_first_issues": f"SELECT case_id, array_to_string(list(position || ':' || rule ORDER BY position, rule)[1:6], ',') AS issues FROM (SELECT case_id, position, unnest(v) AS rule FROM ({_BROKEN})) GROUP BY case_id",
    "answer_counters": "SELECT count(*) AS n_calls, count(*) FILTER (event_id % 7 <> 0 AND event_id % 3 <= 1) AS n_valid, count(*) FILTER (event_id % 7 <> 0 AND event_id % 3 = 2) AS n_repaired, count(*) FILTER (event_id % 7 = 0) AS n_failed FROM events",
    "attack_tallies": f"""SELECT case_id, count(*) AS n_findings, count(*) FILTER (s) AS n_supported, count(*) FILTER (NOT s) AS n_unsupported, count(*) FILTER (p % 3 = 0) AS caught, count(*) FILTER (p % 3 = 0 AND s) AS missed,
        count(*) FILTER (n % 200 >= 100) AS not_retrieved, concat_ws(',', {', '.join(f"CASE WHEN bool_or(contains(t, '{v}')) THEN '{k}' END" for k, v in sorted(MARKERS.items()))}) AS obeyed
        FROM (SELECT l_orderkey % 500 AS case_id, l_linenumber - 1 AS p, l_partkey AS n, repeat('why ', (l_partkey % 9)::INT) || ' ' || repeat('says ', (l_partkey % 4)::INT) AS t,
            (l_linenumber - 1) % 3 > 0 OR l_partkey % 200 < 10 AS s FROM lineitem) GROUP BY case_id""",
    "passage_blocks": f"""{_end(_BM25)} SELECT query_id, sha256(string_agg('[' || rank || '] ' || citation || ' — ' || heading || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS block_sha256
        FROM ({_top('SELECT query_id, chunk_idx, score FROM bm25', 3)}) JOIN corpus USING (chunk_idx) GROUP BY query_id""",
    "health_checks": """SELECT 'index' AS "check", count(*) > 0 AS ok, count(*) || ' chunks from ' || count(DISTINCT source || ':' || doc_id) || ' sections' AS detail FROM documents
        UNION ALL SELECT 'ids', count(*) = count(DISTINCT doc_id), (count(*) - count(DISTINCT doc_id)) || ' repeated' FROM documents
        UNION ALL SELECT 'dimensions', count(DISTINCT len(embedding)) = 1, max(len(embedding)) || 'd' FROM embeddings
        UNION ALL SELECT 'vectors', count(*) = 0, count(*) || ' without a chunk' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
    "paired_spans": f"""{_end(_CALLS)} SELECT s.call_id // 30 AS run_id, 's' || (s.call_id // 3) AS name, s.at_ms AS started_ms, e.at_ms - s.at_ms AS duration_ms, coalesce(e.call_id % 5 = 0, false) AS failed
        FROM c s LEFT JOIN c e ON e.call_id = s.call_id + 1 WHERE s.call_id % 3 = 0""",
    "corpus_backed": "SELECT DISTINCT lang AS framework, true AS has_corpus FROM documents UNION ALL SELECT unnest(['xx', 'SOC 2']), false",
    "framework_list": "SELECT string_agg(lang, ',' ORDER BY lang) AS frameworks FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)",
    "assessment_events": """WITH d AS (SELECT doc_id::VARCHAR AS document_id, doc_id, lang, n_chars % 100 AS score FROM documents),
        f AS (SELECT document_id, framework, score FROM (SELECT *, unnest([lang, 'all']) AS framework FROM d WHERE doc_id % 7 > 0) WHERE framework = 'all' OR score > 20),
        n AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY framework, score) AS seq, framework, score FROM f)
        SELECT document_id, 0 AS seq, 'start' AS type, NULL AS framework, NULL::BIGINT AS score FROM d
        UNION ALL SELECT document_id, seq, 'framework', framework, score FROM n
        UNION ALL SELECT d.document_id, count(f.framework) + 1, 'done', NULL, count(f.framework) FROM d LEFT JOIN f USING (document_id) GROUP BY d.document_id""",
    "cache_stream": f"""{_end(_REPORTS)}, newest AS (SELECT document_hash, report_id FROM r WHERE expires_at > now QUALIFY row_number() OVER (PARTITION BY document_hash ORDER BY created_at DESC, report_id DESC) = 1),
        a AS (SELECT c_custkey AS call_id, c_nationkey, report_id FROM customer LEFT JOIN newest ON document_hash = sha256(c_custkey::VARCHAR) AND c_custkey <> 1)
        SELECT call_id, report_id, CASE WHEN report_id IS NULL THEN row_number() OVER (PARTITION BY c_nationkey, report_id IS NULL ORDER BY call_id) <= {LIMIT} END AS allowed FROM a""",
    "embedding_store": """WITH t AS (SELECT text, doc_id % 3 > 0 AS early FROM documents), n AS (
            SELECT count(DISTINCT text) AS every, count(DISTINCT CASE WHEN early THEN text END) AS early, count(DISTINCT CASE WHEN NOT early THEN text END) AS rest, count(CASE WHEN early THEN 1 END) AS n_early, count(text) AS n FROM t)
        SELECT 0 AS run, n_early AS n_asked, early AS n_computed, early AS n_stored FROM n UNION ALL SELECT 1, n, every - early, every FROM n
        UNION ALL SELECT 2, n, 0, every FROM n UNION ALL SELECT 3, n - n_early, rest, every + rest FROM n""",
    "checked_answers": f"""WITH l AS (SELECT l_orderkey AS call_id, l_partkey AS n, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k FROM lineitem),
        i AS (SELECT call_id, k, list_filter([
                CASE WHEN length('keep ' || n) < 8 THEN 'findings.' || k || '.requirement: too short' END,
                CASE WHEN n % 11 = 0 THEN 'findings.' || k || '.status: missing' WHEN n % 3 <> 0 AND n % 5 = 4 THEN 'findings.' || k || '.status: not one of the allowed values' END,
                CASE WHEN n % 9 = 8 THEN 'findings.' || k || '.note: too long' END], lambda x: x IS NOT NULL) AS v FROM l),
        o AS (SELECT call_id, count(*) AS n_findings, flatten(list(v ORDER BY k)) AS lines FROM i GROUP BY call_id),
        j AS (SELECT call_id, n_findings, CASE WHEN n_findings > 6 THEN ['findings: too many items'] ELSE [] END || lines AS lasting, call_id % 7 = 0 AS broken, call_id % 4 = 0 AS sure FROM o)
        SELECT call_id, CASE WHEN broken OR sure OR len(lasting) > 0 THEN 2 ELSE 1 END AS attempts, len(lasting) = 0 AS valid, array_to_string(lasting, ';') AS issues,
            CASE WHEN len(lasting) = 0 THEN n_findings END AS n_findings FROM j""",
    "recorded_trace": f"""WITH t AS (SELECT doc_id, ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 0.75)::BIGINT AS n FROM documents)
        SELECT 'run' AS run_id, sum(n)::BIGINT AS input_tokens, 3 * count(*) AS output_tokens, {_r('sum(n) * 0.3::DOUBLE / 1e6 + 3 * count(*) * 2.5::DOUBLE / 1e6')} AS cost, 0 AS n_cached, 1 AS n_unpriced,
            (2 * count(*) + count(CASE WHEN doc_id % 2 = 0 THEN 1 END)) AS n_rows, 0 AS n_failed FROM t""",
    "report_insert": f"""{_end(_REPORTS)}, n AS (SELECT now FROM r LIMIT 1), new AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0),
        k AS (SELECT pinned, false AS fresh FROM r WHERE expires_at >= now OR pinned UNION ALL SELECT false, true FROM new)
        SELECT pinned, count(*) AS n, count(*) FILTER (fresh) AS n_new, (SELECT count(*) FROM new) AS n_receipts, 30 AS days FROM k GROUP BY pinned""",
    "pushed_groups": """SELECT source, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE source END AS source FROM documents WHERE doc_id % 2 = 1 OR doc_id % 3 = 0) GROUP BY ROLLUP (source)""",
    "self_probe": "SELECT count(*) AS n_asked, count(*) AS n_found FROM embeddings WHERE vec_id % 20 = 0",
    "request_problems": f"""SELECT doc_id, array_to_string(list_filter([
            CASE WHEN q IS NULL OR length(q) NOT BETWEEN {QUERY_CHARS[0]} AND {QUERY_CHARS[1]} THEN 'query' END, CASE WHEN doc_id % 5 > 0 AND doc_id % 70 > {FRAMEWORK_CHARS} THEN 'framework' END,
            CASE WHEN doc_id % 4 > 0 AND doc_id % 23 NOT BETWEEN 1 AND {MOST_RESULTS} THEN 'k' END, CASE WHEN length(text) > {DOCUMENT_CHARS} THEN 'document' END], lambda x: x IS NOT NULL), ',') AS problems
        FROM (SELECT doc_id, text, CASE WHEN doc_id % 13 > 0 THEN left(text, doc_id % 7 * 100 + doc_id % 3) END AS q FROM documents)""",
    "rerank_prompts": f"""{_end(_BM25)}, f AS (SELECT query_id, 'Question: ' || any_value(b.text) || chr(10) || chr(10)
            || string_agg('[' || (rank - 1) || '] ' || heading || chr(10) || left(c.text, {RERANK_CHARS}), chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Answer with a relevance of 0 to 3 for each of the ' || count(*) || ' passages.' AS prompt
        FROM ({_top('SELECT query_id, chunk_idx, score FROM bm25', 3)}) JOIN corpus c USING (chunk_idx) JOIN benchmark b ON item_id = query_id GROUP BY query_id)
        SELECT query_id, sha256(prompt) AS prompt_sha256, length(prompt) AS n_chars FROM f""",
    "latency_points": f"""{_end(_EVAL)}, m AS (SELECT config, {_MEANS} FROM per GROUP BY config),
        e AS (SELECT CASE event_type WHEN 'view' THEN 'bm25' WHEN 'click' THEN 'dense' WHEN 'signup' THEN 'rrf_equal' WHEN 'purchase' THEN 'rrf_weighted' END AS config, {_r('value / 50', 3)} AS ms FROM events),
        l AS (SELECT config, list(ms ORDER BY ms) AS ms FROM e WHERE config IS NOT NULL GROUP BY config)
        SELECT config, greatest(ms[len(ms) // 2 + 1], 1.0::DOUBLE) AS x, {_r('ndcg * 100', 1)} AS y FROM m JOIN l USING (config)""",
    "report_rows": f"""{_end(_EVAL)}, m AS (SELECT config, slice, {_MEANS} FROM (SELECT *, unnest(['all', CASE query_id % 4 WHEN 2 THEN 'paraphrased' WHEN 3 THEN 'lookup' ELSE 'direct' END]) AS slice FROM per) GROUP BY config, slice)
        SELECT slice, config, '| ' || config || ' | ' || {" || ' | ' || ".join(f"printf('%.1f%%', {_r(f'recall_{k}', 3)} * 100)" for k in DEPTHS)} || ' | ' || printf('%.3f', {_r('mrr', 3)}) || ' | ' || printf('%.3f', {_r('ndcg', 3)}) || ' |' AS line FROM m""",
    "chunk_sections": f"{_recursive(_chunks(TARGET, OVERLAP))} SELECT id, chunk_idx, tokens, ordinal, ordinal_of, sha256(text) AS text_sha256 FROM chunks",
    "chunk_stats": f"""{_recursive(_chunks(TARGET, OVERLAP))}, l AS (SELECT list(tokens ORDER BY tokens) AS t, count(*) AS n FROM chunks)
        SELECT n AS n_chunks, t[1] AS min_tokens, t[n // 2 + 1] AS median_tokens, t[least(n - 1, floor(n * 0.95::DOUBLE)::INT) + 1] AS p95_tokens, t[n] AS max_tokens FROM l""",
    "chunk_size_sweep": f"""{_recursive("".join(_chunks(t, o, f"c{k}") for k, (t, o) in enumerate(SWEEP)))} """
        + " UNION ALL ".join(f"SELECT {t} AS target, {o} AS overlap, count(*) AS n_chunks, {_r('avg(tokens)')} AS avg_tokens FROM c{k}" for k, (t, o) in enumerate(SWEEP)),
    "chunk_sweep_metrics": _recursive(_CORPUS + _GOLD + "sizes AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id)," + "".join(_swept(k, t, o)[0] for k, (t, o) in enumerate(SWEEP)))
        + " " + " UNION ALL ".join(_swept(k, t, o)[1] for k, (t, o) in enumerate(SWEEP)),
    "duplicate_chunk_ids": f"{_recursive(_chunks(TARGET, OVERLAP, citation='source'))} SELECT id, count(*) AS n FROM chunks GROUP BY id HAVING count(*) > 1",
    "rate_limit_ceiling": _CEILED,
    "rate_limit_ceiling_stream": f"SELECT call_id, allowed FROM ({_CEILED})",
    "cache_lookup_exempt": f"""{_end(_REPORTS)} SELECT c_custkey AS request_id, report_id FROM customer JOIN r ON document_hash = sha256(c_custkey::VARCHAR) WHERE c_custkey <> 1 AND expires_at > now
        QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY created_at DESC, report_id DESC) = 1""",
    "number_formats": f"""SELECT l_orderkey, l_linenumber, printf('%.1f%%', {_r('l_extendedprice / 100000', 3)} * 100) AS pct, printf('%.3f', {_r('l_extendedprice / 100000', 3)}) AS three, regexp_full_match(CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END, '[a-z_][a-z0-9_]*') AS safe FROM lineitem""",
    "severity_tones": f"""SELECT severity, CASE severity {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TONES.items())} END AS tone, count(*) AS n FROM (SELECT ['critical', 'high', 'medium', 'low'][l_linenumber % 4 + 1] AS severity FROM lineitem) GROUP BY severity""",
}
