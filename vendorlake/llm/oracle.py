"""DuckDB SQL for the training-data queries that SQL can express."""
from __future__ import annotations

from vendorlake.llm.secrets import BASE_RULES, RULES

_HOST_RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")


def _prior(rule: str) -> str:
    """One row (a, b) as the operator fits them to the hosts' failure rates."""
    return f"""prior_{rule} AS (
      SELECT mean * strength AS a, (1 - mean) * strength AS b FROM (
        SELECT mean, least(greatest(CASE WHEN between_hosts > 0 THEN mean * (1 - mean) / between_hosts - 1 ELSE 1e6 END, 1.0), 1e6) AS strength
        FROM (SELECT mean, square - mean * mean - mean * (1 - mean) * hosts / n AS between_hosts FROM (
          SELECT least(greatest(sum({rule}) / sum(docs), 1e-6), 1 - 1e-6) AS mean, count(*) AS hosts, sum(docs) AS n,
                 sum(docs * ({rule} / docs) * ({rule} / docs)) / sum(docs) AS square FROM hosts))))"""


HOST_QUALITY = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 7)) AS i FROM docs WHERE len(words) >= 8)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM repeated) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS distinct_lines
          FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
f AS (
  SELECT d.doc_id, d.host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines - distinct_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM docs d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)),
fails AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 10 * n_symbols > 3 * n_words AS symbols,
         10 * n_dup_lines > 3 * n_lines AS dup_lines, word_chars > 20 * n_words AS word_length FROM f),
hosts AS (SELECT host, count(*) AS docs, {', '.join(f'sum(CAST({r} AS BIGINT)) AS {r}' for r in _HOST_RULES)} FROM fails GROUP BY host),
{', '.join(_prior(r) for r in _HOST_RULES)},
verdicts AS (
  SELECT host, docs AS host_docs,
         {' OR '.join(f'(hosts.{r} + (SELECT a FROM prior_{r})) / (docs + (SELECT a + b FROM prior_{r})) > 0.5' for r in _HOST_RULES)} AS host_rejected
  FROM hosts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND NOT host_rejected AS kept, fails.host, host_docs, host_rejected
FROM fails JOIN verdicts ON fails.host IS NOT DISTINCT FROM verdicts.host"""

REPEATED_PASSAGES = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS w
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 34)) AS i FROM docs WHERE len(words) >= 35)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 34)) AS p FROM repeated),
kept AS (
  SELECT rid, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS body
  FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs) ANTI JOIN gone USING (rid, p)
  GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)"""


def _secrets() -> str:
    found = " UNION ALL ".join(
        f"""SELECT rid, {n} AS nth, '{r.kind}' AS kind, unnest(generate_series(1, len(hits))) AS i, hits, gaps, {r.group} AS g, {r.least} AS least,
                   '{r.pattern.replace("'", "''")}' AS pattern
            FROM (SELECT rid, regexp_extract_all(text, '{r.pattern.replace("'", "''")}') AS hits,
                         string_split_regex(text, '{r.pattern.replace("'", "''")}') AS gaps FROM docs)"""
        for n, r in enumerate(RULES))
    held = " ".join(f"""WHEN nth = {n} THEN length(regexp_extract(hits[i], '{r.pattern.replace("'", "''")}', {r.group}))"""
                    for n, r in enumerate(RULES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
spans AS (
  SELECT rid, nth, kind, length(hits[i]) AS len, CASE {held} END AS held, least,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start FROM found),
told AS (
  SELECT rid, nth, start, kind, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + len AS BIGINT) AS s FROM spans WHERE held >= least),
per AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(s, ',' ORDER BY start, nth) FILTER (nth < {len(BASE_RULES)}) AS base,
         string_agg(s, ',' ORDER BY start, nth) AS spans FROM told GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (rid)"""


NEAR_DUPLICATES = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT rid, array_to_string(words[i:i + 3], ' ') AS s
  FROM (SELECT rid, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
links AS (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.rid <> y.rid GROUP BY ALL)
  JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT r.a AS rid, min(d.doc_id) AS m FROM reach r JOIN docs d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, m), doc_id, m) AS component_id,
       doc_id IS NOT DISTINCT FROM coalesce(least(doc_id, m), doc_id, m) AS kept
FROM docs LEFT JOIN sizes USING (rid) LEFT JOIN least_id USING (rid)"""

#: Unsigned CRC-32 of a number's decimal text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda crc, byte: list_reduce([CAST(1 AS BIGINT), 2, 3, 4, 5, 6, 7, 8], lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END,
                                xor(crc, byte)), CAST(4294967295 AS BIGINT)))"""

CONVERSATION_TRIE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS root, {_CRC32.format("conv_id")} % 6 AS h FROM turns GROUP BY conv_id),
built AS (
  SELECT c.conv_id, t.p, role, text FROM convs c JOIN turns t ON t.conv_id = c.root AND t.p <= c.h
  UNION ALL SELECT conv_id, p, role, text FROM turns JOIN convs USING (conv_id) WHERE p > h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, sha256(length(role) || ':' || role || text) AS turn, length(text) AS chars FROM built),
sizes AS (SELECT conv_id, coalesce(n, 0) AS n FROM convs LEFT JOIN (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id) USING (conv_id)),
member AS (
  SELECT conv_id, 0 AS d, '' AS path, NULL AS up, 0 AS chars FROM convs
  UNION ALL
  SELECT conv_id, d, sha256(string_agg(turn, '') OVER w), CASE WHEN d > 1 THEN sha256(string_agg(turn, '') OVER v) ELSE '' END, chars
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY d), v AS (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nodes AS (
  SELECT d, path, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM member JOIN sizes USING (conv_id) GROUP BY d, path),
kids AS (SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (SELECT *, coalesce(n_children, 0) AS kids FROM nodes LEFT JOIN kids USING (d, path)),
subtree AS (
  SELECT m.d, m.path, count(*) FILTER (WHERE v.kids = 0) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
  FROM valued v JOIN member m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY ALL)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.kids AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN subtree s ON s.d = v.d AND s.path = v.path LEFT JOIN nodes q ON q.d = v.d - 1 AND q.path = v.up"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COLLOCATIONS = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
found AS (SELECT lang, p, k, f AS a FROM counts WHERE k >= 2),
inner_runs AS (
  SELECT lang, a, p[i:i + size - 1] AS p FROM (
    SELECT lang, a, p, size, unnest(generate_series(1, k - size + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS size FROM found WHERE k >= 3))),
covers AS (SELECT lang, p, max(a) AS cover FROM inner_runs GROUP BY ALL),
cuts AS (SELECT lang, p, a, k, unnest(generate_series(1, k - 1)) AS cut FROM found LEFT JOIN covers USING (lang, p)
         WHERE cover IS NULL OR CAST(cover AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80),
scores AS (SELECT c.*, x.f AS l, y.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
           FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:cut] JOIN counts y ON y.lang = c.lang AND y.p = c.p[cut + 1:]),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank,
                  array_to_string(p, ' ') AS phrase, a, l, r, score FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""

ORACLE_SQL = {"op11_conversation_trie": CONVERSATION_TRIE, "op13_collocations": COLLOCATIONS,
              "op3_host_quality": HOST_QUALITY, "op5_secret_ledger": _secrets(), "op7_minhash_near_dedup": NEAR_DUPLICATES,
              "op9_debruijn_dedup": REPEATED_PASSAGES}
