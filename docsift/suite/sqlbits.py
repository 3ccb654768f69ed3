"""SQL fragments of the oracles."""

from __future__ import annotations

WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def strip_list(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda s: {strip('s')}), lambda s: s <> '')"


def sentences_keep(x: str) -> str:
    marked = f"regexp_replace({x}, '([.?!]){WS}+', '\\1' || chr(1), 'g')"
    return strip_list(f"string_split_regex({marked}, '\\x01|\\n+')")


def sentences_drop(x: str) -> str:
    return strip_list(f"string_split_regex({x}, '[.!?]+{WS}+')")


def dedup_key(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '{WS}+', ' ', 'g')"


def word_window_cte(size: int, step: int, src: str = "documents", key: str = "doc_id", extra: str = "") -> str:
    """SELECT of (key, pos, text) windows."""
    return f"""
      SELECT {key}{extra}, k + 1 AS pos, array_to_string(ws[(k * {step} + 1):(k * {step} + {size})], ' ') AS text
      FROM (SELECT {key}{extra}, ws, unnest(range(0, CAST(ceil(len(ws) / {step}.0) AS BIGINT))) AS k
            FROM (SELECT {key}{extra}, {words('text')} AS ws FROM {src}))"""


def char_window_cte(size: int, overlap: int, src: str = "documents", key: str = "doc_id", extra: str = "") -> str:
    step = size - overlap
    return f"""
      SELECT {key}{extra}, k + 1 AS pos, substring(text, k * {step} + 1, {size}) AS text
      FROM (SELECT {key}{extra}, text, unnest(range(0, CASE WHEN length(text) >= {size}
                 THEN (length(text) - {size}) // {step} + 2 ELSE 1 END)) AS k
            FROM {src} WHERE length(text) > 0)"""


def gram_rows(src: str, key: str, ws: str, upto: int) -> str:
    """SELECT of (key, gram) over word lists ``ws``: neighbours are joined by window functions."""
    if upto == 1:
        return f"SELECT {key}, unnest({ws}) AS gram FROM {src}"
    leads = ", ".join(f"lead(w, {n}) OVER x AS w{n}" for n in range(1, upto))
    grams = ", ".join(" || ' ' || ".join(["w", *[f"w{i}" for i in range(1, n)]]) for n in range(1, upto + 1))
    return f"""SELECT {key}, gram FROM (SELECT {key}, unnest([{grams}]) AS gram FROM (
        SELECT {key}, w, {leads} FROM (SELECT {key}, unnest({ws}) AS w, unnest(range(1, len({ws}) + 1)) AS p FROM {src})
        WINDOW x AS (PARTITION BY {key} ORDER BY p))) WHERE gram IS NOT NULL"""


def bm25(docs: str, queries: str, upto: int = 1, toks=tokens, p: str = "b") -> str:
    """CTEs ending in ``s(query_id, id, score)`` and ``{p}_rank``; ``docs(id, text)``, ``queries(query_id, text)``."""
    length = " + ".join(f"greatest(len(ws) - {n}, 0)" for n in range(upto))
    return f"""
    {p}_d AS MATERIALIZED (SELECT id, ws, {length} AS dl FROM (SELECT id, {toks('text')} AS ws FROM {docs} WHERE trim(text) <> '')),
    {p}_tf AS MATERIALIZED (SELECT id, gram AS token, count(*) AS tf FROM ({gram_rows(p + '_d', 'id', 'ws', upto)}) GROUP BY ALL),
    {p}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}_d),
    {p}_raw AS MATERIALIZED (SELECT token, ln({p}_st.n - df + 0.5) - ln(df + 0.5) AS raw
              FROM (SELECT token, count(*) AS df FROM {p}_tf GROUP BY token), {p}_st),
    {p}_idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}_raw) ELSE raw END AS idf FROM {p}_raw),
    {p}_q0 AS (SELECT query_id, {toks('text')} AS ws FROM {queries}),
    {p}_q AS MATERIALIZED (SELECT query_id, gram AS token, count(*) AS qtf FROM ({gram_rows(p + '_q0', 'query_id', 'ws', upto)}) GROUP BY ALL),
    {'s' if p == 'b' else p + '_s'} AS MATERIALIZED (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / {p}_st.avgdl))), 6) AS score
          FROM {p}_q JOIN {p}_idf USING (token) JOIN {p}_tf USING (token) JOIN {p}_d USING (id), {p}_st GROUP BY query_id, id),
    {p}_full AS MATERIALIZED (SELECT q.query_id, d.id, coalesce(s.score, 0.0) AS score
          FROM (SELECT DISTINCT query_id FROM {p}_q) q CROSS JOIN {p}_d d LEFT JOIN {'s' if p == 'b' else p + '_s'} s ON s.query_id = q.query_id AND s.id = d.id),
    {p}_mm AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM {p}_full GROUP BY query_id),
    {p}_rank AS MATERIALIZED (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk,
                 CASE WHEN hi = lo THEN 1.0 ELSE round((score - lo) / (hi - lo), 6) END AS norm,
                 CASE WHEN hi > 0 THEN round(score / hi, 6) ELSE score END AS by_max
               FROM {p}_full JOIN {p}_mm USING (query_id))"""


def embedding_cells(src: str, key: str, text: str = "text", dim: int = 64) -> str:
    """SELECT of (key, dim, v): signed token hashing scaled to unit length."""
    return f"""
      SELECT {key}, d, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM (
        SELECT {key}, (CAST('0x' || substring(h, 1, 2) AS BIGINT)) % {dim} AS d,
               sum(CASE WHEN CAST('0x' || substring(h, 3, 1) AS BIGINT) < 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v
        FROM (SELECT {key}, md5(t) AS h FROM (SELECT {key}, unnest({tokens(text)}) AS t FROM {src}))
        GROUP BY ALL) WHERE v <> 0"""
