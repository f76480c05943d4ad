"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import mixing
from .quality_rules import RULES, STOP_WORDS

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _op5() -> str:
    weights = ", ".join(str(float(w)) for w in mixing.WEIGHTS)
    trials = ", ".join(
        f"CAST(sum(CASE WHEN CAST(('0x' || substr(hex, {k}, 12)) AS UBIGINT) / 281474976710656.0E0 "
        f"< rate - floor(rate) THEN size ELSE 0 END) AS DOUBLE)" for k in range(1, mixing.TRIALS + 1))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
             md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS hex FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{weights}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS INT)] AS weight,
        source_size * {mixing.MAX_REPEAT:.1f}E0 AS cap FROM s),
t AS (SELECT *, least(sum(source_size) OVER () * {mixing.TOTAL_SHARE}E0, sum(cap) OVER ()) AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
f AS (SELECT min_by(level, cap / weight) AS water FROM l WHERE level * weight <= cap),
g AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g),
x AS (SELECT d.source, any_value(target) AS target, any_value(rate) AS rate, any_value(source_size) AS source_size,
        [{trials}] AS extra FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source GROUP BY d.source),
b AS (SELECT source, list_min(list_transform(range(1, {mixing.TRIALS} + 1), lambda k:
        {{'miss': abs(floor(rate) * source_size + extra[k] - target), 'k': k}})).k AS trial FROM x)
SELECT d.doc_id, d.size, r.source_size, round(r.target, 6) AS target,
  CAST(d.size * (floor(rate) + CASE WHEN CAST(('0x' || substr(hex, CAST(trial AS INT), 12)) AS UBIGINT) / 281474976710656.0E0
    < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN b ON d.source IS NOT DISTINCT FROM b.source"""


def _op8() -> str:
    stops = ", ".join("'" + w + "'" for w in STOP_WORDS)
    checks = []
    for r in RULES:
        ok = " AND ".join(x for x in (f"{r.metric} >= {r.low}" if r.low is not None else "",
                                      f"{r.metric} <= {r.high}" if r.high is not None else "") if x)
        checks.append(f"(({ok}) OR n_words < {r.from_words})" if r.from_words else f"({ok})")
    return rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a) _a),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) _w WHERE n > 1),
cov AS (SELECT doc_id, CAST(sum(least(5, i - prev)) AS BIGINT) AS n_repeat_words FROM (
    SELECT doc_id, i, lag(i, 1, i - 5) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM rep) _r GROUP BY doc_id),
m AS (SELECT a.doc_id, t, w, lines, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM a LEFT JOIN cov USING (doc_id)),
n AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
    coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_share,
    coalesce(len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) / nullif(n_words, 0), 0) AS upper_word_share,
    coalesce((length(t) - length(replace(t, '!', ''))) / nullif(n_words, 0), 0) AS exclamations_per_word,
    coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) / nullif(n_lines, 0), 0) AS ellipsis_line_share,
    coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[•*\-–]'))) / nullif(n_lines, 0), 0) AS bullet_line_share,
    coalesce(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / nullif(n_words, 0), 0) AS letter_word_share,
    coalesce(len(list_filter(w, lambda x: lower(trim(x, '.,;:!?')) IN ({stops}))) / nullif(n_words, 0), 0) AS stop_word_share
  FROM m),
v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {" AND ".join(checks)}) AS kept FROM v"""


def _op1() -> str:
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(node, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.node)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept
FROM r JOIN d ON d.doc_id = r.node LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def _op2() -> str:
    return """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL
    OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.node)
SELECT node AS vec_id, coalesce(any_value(k), 0) AS n_links, min(m) AS component_id, node = min(m) AS kept
FROM r LEFT JOIN (SELECT x, count(*) AS k FROM l GROUP BY x) c ON c.x = node GROUP BY node"""


def _op12() -> str:
    split = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
    return f"""
WITH i AS (SELECT item_id, unnest({split}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM i GROUP BY ALL),
d AS (SELECT doc_id, {split} AS w FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) _d
  GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight FROM f, c),
s AS (SELECT item_id, doc_id, CAST(sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) _s WHERE rank <= 20"""


ORACLES = {"op1_ngram_jaccard": _op1(), "op2_embedding_dedup": _op2(), "op5_mixing": _op5(), "op8_quality_rules": _op8(),
           "op12_lexical_search": _op12()}
