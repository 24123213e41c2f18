"""DuckDB SQL for the queries whose results SQL can express."""

_KEY = r"translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH lines AS (
    SELECT doc_id, pos, whole[pos] AS line, len(whole) AS n_lines
    FROM (SELECT doc_id, whole, unnest(range(1, len(whole) + 1)) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS whole FROM documents))
), keyed AS (
    SELECT *, {_KEY} AS key FROM lines
), owners AS (
    SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
    SELECT k.doc_id, k.pos, k.line, k.n_lines, coalesce(k.doc_id > o.owner, false) AS gone
    FROM keyed k LEFT JOIN owners o ON k.key = o.key AND length(k.key) >= 10
)
SELECT doc_id, max(n_lines)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP6 = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':mix-0') AS mix_key
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM sized GROUP BY source
), ranked AS (
    -- Sources in the order in which they reach three times their size as the level rises.
    SELECT *, 3.0 * source_size AS cap,
           coalesce(sum(3.0 * source_size) OVER before, 0) AS held, sum(weight) OVER after AS open_weight,
           sum(source_size) OVER () AS total
    FROM sources
    WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           after AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
    SELECT max((total - held)::DOUBLE / open_weight) AS level FROM ranked
    WHERE (total - held)::DOUBLE / open_weight * weight <= cap
), targets AS (
    SELECT r.source, r.source_size, least(r.weight * l.level, r.cap) AS target FROM ranked r, level l
), placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mix_key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (epochs + CASE WHEN target - epochs * source_size > 0
                               AND 2.0 * (target - epochs * source_size - before) >= size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

_CODES = """
    SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS bits
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
"""

OP4 = f"""
WITH codes AS ({_CODES}), asked AS (SELECT DISTINCT vec_id, bits FROM codes WHERE vec_id % 100 = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(range(1, 65), lambda i: (q.bits[i] <> c.bits[i])::INT))::INT AS distance
    FROM asked q, codes c
), ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


def _spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    found, gaps = f"regexp_extract_all(t, '{quoted}')", f"string_split_regex(t, '{quoted}')"
    values = f"regexp_extract_all(t, '{quoted}', {group})"
    return f"""
    SELECT doc_id, '{kind}' AS kind, {place} AS place, k, start, start + size AS "end" FROM (
        SELECT doc_id, k, got, size, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT - size AS start FROM (
            SELECT doc_id, k, length(gaps[k]) AS gap, length(found[k]) AS size, length(got[k]) AS got
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k
                  FROM (SELECT doc_id, {found} AS found, {gaps} AS gaps, {values} AS got FROM texts))
        )
    ) WHERE got >= {least}"""


_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

# RE2 has no looking back: in a run of token characters and dots a token begins at the run's begin or after a dot.
_TOKEN = r"(?:^|\.)(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
_JWT = rf"""
    SELECT doc_id, 'jwt' AS kind, 4 AS place, k, begun + upto - size AS start, begun + upto AS "end" FROM (
        SELECT doc_id, k, begun, length(tokens[j]) AS size, sum(length(gaps[j]) + length(found[j])) OVER (PARTITION BY doc_id, k ORDER BY j)::BIGINT AS upto FROM (
            SELECT *, unnest(range(1, len(found) + 1)) AS j FROM (
                SELECT doc_id, k, begun, string_split_regex(run, '{_TOKEN}') AS gaps, regexp_extract_all(run, '{_TOKEN}') AS found, regexp_extract_all(run, '{_TOKEN}', 1) AS tokens FROM (
                    SELECT doc_id, k, runs[k] AS run, sum(length(around[k]) + length(runs[k])) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT - length(runs[k]) AS begun
                    FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9_.-]+') AS runs, string_split_regex(t, '[A-Za-z0-9_.-]+') AS around FROM texts WHERE contains(t, 'eyJ')))
                ) WHERE contains(run, 'eyJ')
            )
        )
    )"""

OP9 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans("assign", 0, _ASSIGN, 2, 12)}
    UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 18)}
    UNION ALL {_spans("hex", 2, "[0-9a-f]+", 0, 16)}
    UNION ALL {_spans("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0)}
    UNION ALL {_JWT}
), of_doc AS (
    SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
           string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, place) FILTER (place < 3) AS base,
           string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, place) AS spans
    FROM found GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN of_doc f ON t.doc_id = f.doc_id
"""

_STEP = "lambda x, i: xor(x >> 1, 3988292384 * (x & 1))"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(c) + 1), lambda i: ascii(c[i])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), {_STEP})), 4294967295)"

OP12 = rf"""
WITH turns AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
    SELECT conv_id, n, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS h
    FROM (SELECT conv_id, conv_id::VARCHAR AS c, count(*) AS n FROM turns GROUP BY conv_id)
), rebuilt AS (
    SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.pos - c.h, t.role, t.text
    FROM convs c LEFT JOIN convs b ON b.conv_id = c.base JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), paths AS (
    SELECT conv_id, pos AS depth, len(regexp_extract_all(text, '[^ \t-\r]+')) AS words,
           sha256(to_json(list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY pos))::VARCHAR) AS node
    FROM rebuilt
), steps AS (
    SELECT conv_id, depth, words, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent FROM paths
    UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs
), nodes AS (
    SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM steps GROUP BY node
), kids AS (
    SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
    SELECT s.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum(u.saved) AS saved_tokens
    FROM nodes u LEFT JOIN kids k ON k.node = u.node JOIN steps s ON s.conv_id = u.conv_id AND s.depth <= u.depth GROUP BY s.node
), ends AS (
    SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, arg_max(node, depth) AS node FROM steps GROUP BY conv_id) GROUP BY node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node LEFT JOIN ends e ON e.node = n.node
"""

OP13 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), whole AS (
    SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), counts AS (
    SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), shares AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (t.n + 5 * w.v) AS p, 1 + (1000000000 * (k.n + 5)) // (w.n + 5 * w.v) AS q
    FROM totals t JOIN whole w ON w.lang = t.lang JOIN kept k ON k.lang = t.lang
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op4_binary_topk": OP4,
    "op6_source_mixing": OP6,
    "op9_secret_scan": OP9,
    "op12_prefix_trie": OP12,
    "op13_source_divergence": OP13,
}
