"""DuckDB SQL that gives the rows of the queries that SQL can express, each written plainly from what the query promises.

The other queries tokenize, hash with XXH64 or hold a fitted model, which SQL can't; tests hold them against brute force.
"""

from __future__ import annotations

from .common import LOWER, UPPER
from .decontamination import EDGES, PUNCTUATION, SHINGLE, SIMILARITY
from .line_dedup import EDIT_WORDS
from .secret_scan import CLASSES, WINDOW
from .substring_dedup import LENGTH

WORDS = r"[^\x20\x09-\x0D]+"

#: Bytes as hex, two characters each. A start p is flagged where its string starts in an earlier document too; flagged starts no
#: more than LENGTH apart leave no byte between them, so they make one removed run.
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 2 * {LENGTH}) AS s FROM (SELECT r, doc_id, h, unnest(range(greatest(0, length(h) // 2 - {LENGTH} + 1))) AS p FROM d)),
f AS (SELECT r, p FROM s JOIN (SELECT s, min(doc_id) AS least FROM s GROUP BY s) USING (s) WHERE least < doc_id),
g AS (SELECT r, p, p > lag(p, 1, -{LENGTH} - 1) OVER (PARTITION BY r ORDER BY p) + {LENGTH} AS new FROM f),
runs AS (SELECT r, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS n FROM g) GROUP BY r, n),
cuts AS (SELECT r, a, b FROM runs UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM d),
gaps AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a, b) AS since FROM cuts),
k AS (SELECT r, sum(b - a) AS removed, sum((b > a)::INT) AS spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b) AS kept FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, removed::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k USING (r)
"""


def _found(kind: str, k: int, pattern: str, group: int, least: int) -> str:
    """SELECT of r, k, kind, start, stop and found: matches of a pattern whose group is long enough."""
    at = "sum(length(gap) + length(whole)) OVER (PARTITION BY r ORDER BY i)"
    return f"""
SELECT r, {k} AS k, '{kind}' AS kind, stop - length(whole) AS start, stop, found FROM (
  SELECT r, whole, found, {at} AS stop FROM (
    SELECT r, unnest(wholes) AS whole, unnest(founds) AS found, unnest(gaps[:len(wholes)]) AS gap, unnest(range(len(wholes))) AS i FROM (
      SELECT r, regexp_extract_all(text, '{pattern}', 0) AS wholes, regexp_extract_all(text, '{pattern}', {group}) AS founds, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)))
WHERE length(found) >= {least}"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALPHABET = UPPER + LOWER + "0123456789+/_=-"
_RULERS = "|".join(f"[{c}]{{8}}" for c in _ALPHABET)
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_found("assign", 0, _ASSIGN, 2, 12)} UNION ALL {_found("access", 1, "AKIA[A-Z0-9]+", 0, 18)} UNION ALL {_found("hex", 2, "[0-9a-f]+", 0, 16)}),
seen AS ({_found("", 3, "[A-Za-z0-9+/_=-]+", 0, WINDOW)}),
free AS (
  SELECT * FROM seen WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = seen.r AND base.start < seen.stop AND seen.start < base.stop)
  AND NOT regexp_matches(found, '{_either("example")}') AND NOT regexp_full_match(found, '[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}')
  AND NOT regexp_full_match(found, '[A-Za-z/_-]+[0-9]{{0,4}}') AND NOT regexp_full_match(found, '[0-9/_=+-]+') AND NOT regexp_matches(found, '{_RULERS}')),
windows AS (SELECT found, i, unnest(string_split(substr(found, i, {WINDOW}), '')) AS c FROM (SELECT found, unnest(range(1, length(found) - {WINDOW} + 2)) AS i FROM (SELECT DISTINCT found FROM free))),
bits AS (SELECT found, i, -sum(n / {WINDOW} * log2(n / {WINDOW})) AS e FROM (SELECT found, i, c, count(*) AS n FROM windows GROUP BY ALL) GROUP BY ALL),
peak AS (SELECT found, max(e) AS e FROM bits GROUP BY found),
added AS (
  SELECT r, k, CASE WHEN regexp_full_match(found, '[0-9A-Fa-f]+') AND e >= {CLASSES[0][2]} THEN '{CLASSES[0][0]}'
    WHEN regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[a-z]') AND e >= {CLASSES[1][2]} THEN '{CLASSES[1][0]}' END AS kind, start, stop
  FROM free JOIN peak USING (found)),
spans AS (SELECT r, k, kind, start, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM (SELECT r, k, kind, start, stop FROM base UNION ALL SELECT * FROM added) WHERE kind IS NOT NULL),
j AS (
  SELECT r, sum((k = 0)::INT) AS a, sum((k = 1)::INT) AS b, sum((k = 2)::INT) AS c, string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)
"""

#: Lines as their words; u is a distinct line, t its earliest place, v a line less its i-th word.
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, number, line, words, dense_rank() OVER (ORDER BY doc_id, number) AS t, md5(array_to_string(words, ' ')) AS u
  FROM (SELECT r, doc_id, number, line, regexp_extract_all(line, '{WORDS}') AS words FROM (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS number FROM d))),
first AS (SELECT u, min(t) AS t, any_value(words) AS words FROM l WHERE len(words) > 0 GROUP BY u),
long AS (SELECT u, t, words FROM first WHERE len(words) >= {EDIT_WORDS}),
v AS (SELECT u, t, i, md5(array_to_string(list_concat(words[:i - 1], words[i + 1:]), ' ')) AS rest FROM (SELECT u, t, words, unnest(range(1, len(words) + 1)) AS i FROM long)),
near AS (
  SELECT u, t FROM first
  UNION ALL SELECT u, min(t) OVER (PARTITION BY rest, i) FROM v
  UNION ALL SELECT long.u, v.t FROM long JOIN v ON long.u = v.rest
  UNION ALL SELECT v.u, long.t FROM long JOIN v ON long.u = v.rest),
least AS (SELECT u, min(t) AS least FROM near GROUP BY u),
told AS (SELECT r, number, line, coalesce(least < t, false) AND len(words) > 0 AS gone FROM l LEFT JOIN least USING (u)),
k AS (
  SELECT r, count(*) AS n, sum(gone::INT) AS m, string_agg(line, chr(10) ORDER BY number) FILTER (WHERE NOT gone) AS text, list(number::INT ORDER BY number) FILTER (WHERE gone) AS dropped
  FROM told GROUP BY r)
SELECT doc_id, coalesce(text, '') AS text, n::BIGINT AS n_lines, m::BIGINT AS n_dropped, coalesce(dropped, []::INT[]) AS dropped FROM d JOIN k USING (r)
"""


def _item_words(text: str) -> str:
    plain = f"trim(x, '{PUNCTUATION.replace(chr(39), 2 * chr(39))}')"
    bare = f"coalesce(nullif(regexp_replace({plain}, '{EDGES}', '', 'g'), ''), {plain})"
    return f"list_filter(list_transform(regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORDS}'), lambda x: {bare}), lambda x: x <> '')"


#: Of a benchmark of one index. Windows of a document's words as the operator lays them; part 2 is the whole item; m is the words of a part's shingles.
OP10_SQL = f"""
WITH items AS (SELECT row_number() OVER () AS item, item_id, {_item_words("text")} AS w FROM benchmark),
parts AS (
  SELECT item, 0 AS part, w[:len(w) - len(w) // 3] AS w FROM items WHERE len(w) > 0
  UNION ALL SELECT item, 1, w[len(w) - len(w) // 3 + 1:] FROM items WHERE len(w) // 3 > 0
  UNION ALL SELECT item, 2, w FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, part, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least({SHINGLE}, len(w)) AS m FROM parts))),
totals AS (SELECT item, part, count(*) AS total FROM grams GROUP BY ALL),
laid AS (SELECT greatest(64, 2 * max(len(w))) AS width, greatest(64, 2 * max(len(w))) - max(len(w)) + 1 AS stride FROM items),
d AS (SELECT row_number() OVER () AS r, doc_id, {_item_words("text")} AS w FROM documents),
have AS (SELECT r, m, len(w) AS n, p, array_to_string(w[p + 1:p + m], ' ') AS gram FROM (SELECT r, w, m, unnest(range(len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM grams) WHERE len(w) >= m)),
hits AS (
  SELECT r, item, part, gram, unnest(range(greatest(0, ceil((p + m - width) / stride)::BIGINT), least(p // stride, greatest(0, ceil((n - width) / stride)::BIGINT)) + 1)) AS passage
  FROM have JOIN grams USING (m, gram), laid),
share AS (SELECT r, item, passage, part, count(DISTINCT gram) / any_value(total) AS part_share FROM hits JOIN totals USING (item, part) GROUP BY r, item, passage, part),
pairs AS (
  SELECT r, item, passage, coalesce(max(part_share) FILTER (WHERE part = 0), 0) AS q, CASE WHEN item IN (SELECT item FROM totals WHERE part = 1) THEN coalesce(max(part_share) FILTER (WHERE part = 1), 0) ELSE 1.0::DOUBLE END AS a,
    coalesce(max(part_share) FILTER (WHERE part = 2), 0) AS whole
  FROM share GROUP BY r, item, passage),
judged AS (SELECT *, q >= {SIMILARITY}::DOUBLE AND a >= {SIMILARITY}::DOUBLE AS by_parts FROM pairs),
told AS (SELECT *, bool_or(by_parts) OVER (PARTITION BY r, item) AS any_by_parts FROM judged WHERE by_parts OR whole >= {SIMILARITY}::DOUBLE)
SELECT doc_id, item_id, count(*)::BIGINT AS n_passages, max(q)::DOUBLE AS question_overlap, max(a)::DOUBLE AS answer_overlap
FROM told JOIN d USING (r) JOIN items USING (item) WHERE by_parts OR NOT any_by_parts GROUP BY r, item, doc_id, item_id
"""
