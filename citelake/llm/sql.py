"""The SQL of the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations

from citelake.llm import secret_scan, sharding
from citelake.llm.queries import SHARDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _secrets() -> str:
    parts = []
    for order, rule in enumerate(secret_scan.RULES):
        p = _text(rule.pattern)
        parts.append(
            f"""SELECT rid, {order} AS ord, '{rule.kind}' AS kind, {rule.least} AS least,
            unnest(range(1, len(f) + 1)) AS i, unnest(f) AS found, unnest(g) AS held, unnest(s[1:len(f)]) AS gap
            FROM (SELECT rid, regexp_extract_all(t, {p}, 0) AS f, regexp_extract_all(t, {p}, {rule.group}) AS g,
                  string_split_regex(t, {p}) AS s FROM d WHERE regexp_matches(t, {p}))"""
        )
    counts = ", ".join(
        f"coalesce(count(*) FILTER (WHERE kind = '{r.kind}'), 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES
    )
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
    one = "kind || ':' || s || ':' || e"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    p AS (SELECT *, length(gap) + sum(length(gap) + length(found)) OVER (PARTITION BY rid, ord ORDER BY i)
                 - length(gap) - length(found) AS s FROM m),
    k AS (SELECT rid, ord, kind, CAST(s AS BIGINT) AS s, CAST(s + length(found) AS BIGINT) AS e
          FROM p WHERE length(held) >= least)
    SELECT doc_id, {counts},
           sha256(coalesce(string_agg({one}, ',' ORDER BY s, ord) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
           coalesce(string_agg({one}, ',' ORDER BY s, ord) FILTER (WHERE kind IS NOT NULL), '') AS spans
    FROM d LEFT JOIN k USING (rid) GROUP BY rid, doc_id"""


_WS = r"[ \t-\r]+"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
                  trim(coalesce(text, ''), {_BLANKS}) AS b FROM documents),
w AS (SELECT rid, doc_id, host, t, CASE WHEN b = '' THEN [] ELSE string_split_regex(b, '{_WS}') END AS w,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i,
             unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS gram
      FROM w WHERE len(w) > 2),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS j
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid),
s AS (SELECT w.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON r.rid = w.rid),
x AS (SELECT rid, doc_id, host, t, unnest(l) AS raw FROM w),
n AS (SELECT *, regexp_replace(lower(regexp_replace(trim(raw, {_BLANKS}), '{_WS}', ' ', 'g')), '[0-9]', '0', 'g') AS line
      FROM x),
f AS (SELECT host, line FROM n GROUP BY host, line HAVING count(DISTINCT (doc_id, t)) > 20),
o AS (SELECT rid, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS gone FROM n JOIN f USING (host, line) GROUP BY rid),
v AS (SELECT s.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, o.gone FROM s LEFT JOIN o USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (gone IS NULL OR n_words - gone >= n_words * 0.2)) AS kept,
       coalesce(gone, 0) AS n_removed_words
FROM v"""


def _sharding() -> str:
    slots = ",".join(map(str, sharding.fill_table(SHARDS)))
    return f"""
    WITH t AS (SELECT unnest(range(0, {sharding.TABLE_SIZE})) AS slot, CAST(unnest(string_split('{slots}', ',')) AS INT) AS k),
    d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
                 % {sharding.TABLE_SIZE} AS INT) AS slot FROM documents)
    SELECT doc_id, d.slot, 'shard-' || lpad(CAST(k AS VARCHAR), 3, '0') AS shard FROM d JOIN t USING (slot)"""


CHATS = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
                + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS n,
             length(role) + length(role) - length(replace(role, '\', ''))
                + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) AS m FROM r),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(20 + n + m) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS terms FROM documents),
o AS (SELECT lang, source, rid, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v) AS p
      FROM t JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(l.total) + 5 * any_value(v.v)) AS q
      FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) l USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
      LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
      GROUP BY a.lang, a.source, b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 50"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
             CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
      FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


SQL = {
    "op2_secret_scan": _secrets(),
    "op3_quality_rules": QUALITY,
    "op4_sharding": _sharding(),
    "op8_chat_format": CHATS,
    "op10_topk": TOP_K,
    "op11_source_divergence": DIVERGENCE,
    "op13_hard_negatives": HARD_NEGATIVES,
}
