"""SQL equivalents (DuckDB) of the queries that SQL can express."""

LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM docs),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, f.k IS NOT NULL AND f.keeper <> l.doc_id AS gone FROM keyed l LEFT JOIN frequent f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(ws), 13) AS l, array_to_string(ws[i:i + 12], ' ') AS w
    FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
runs AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS w FROM (
    SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM wins) WHERE len(ws) >= l)),
found AS (SELECT r.doc_id, r.i, r.l, w.item FROM runs r JOIN wins w ON r.w = w.w AND r.l = w.l),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT DISTINCT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
    d.doc_id <= coalesce(low.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN low ON d.doc_id = low.a
"""

CHAT_FORMAT = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(n)),
turns AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS opens FROM said
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|NAME\]|TURN\])', '\1\\\2\3', 'g')) +
    CASE WHEN NOT opens THEN 6 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7
    ELSE 19 + length(role) END AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (opens) AS n_blocks
FROM sized GROUP BY conv_id
"""


def _assigned(book: str) -> str:
    """Every part's nearest entry of a codebook and the squared distance."""
    return f"""(SELECT vec_id, part, min({{'d': d, 'entry': entry}}) AS best FROM (
        SELECT vec_id, f.part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d
        FROM flat f JOIN {book} b ON f.part = b.part AND f.pos = b.pos GROUP BY ALL) GROUP BY ALL)"""


def _improved(book: str, assigned: str) -> str:
    return f"""(SELECT b.part, b.entry, b.pos, CAST(coalesce((s - ((s % n) + n) % n) // n, c) AS BIGINT) AS c FROM {book} b LEFT JOIN (
        SELECT f.part, a.best.entry AS entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
        FROM flat f JOIN {assigned} a ON f.vec_id = a.vec_id AND f.part = a.part GROUP BY ALL) m
        ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""


VECTOR_CODES = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding,
        lambda x: coalesce(abs(CAST(x AS DOUBLE)) < 65536, false)))),
flat AS MATERIALIZED (SELECT vec_id, p // w AS part, p % w AS pos, v[p + 1] AS x
    FROM (SELECT vec_id, v, len(v) // 16 AS w, unnest(range(len(v))) AS p FROM kept)),
b0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM flat JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) USING (vec_id)),
a0 AS MATERIALIZED {_assigned('b0')}, b1 AS MATERIALIZED {_improved('b0', 'a0')},
a1 AS MATERIALIZED {_assigned('b1')}, b2 AS MATERIALIZED {_improved('b1', 'a1')},
a2 AS MATERIALIZED {_assigned('b2')},
codes AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
    FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""


def _with(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 't': {state}.t || '{letter}'}}"


def _own(row: str) -> dict[str, str]:
    """The states after one row, insertions behind it left out; 99999999 stands for out of reach."""
    delete = {q: _with(q, "4", "D") for q in "nsua"}
    fine, extra = f"NOT {row}.blank AND NOT {row}.dup", f"CASE WHEN {row}.trunc THEN 3 ELSE 0 END"

    def stay(source: str, role: str) -> str:
        ways = [_with(source, f"CASE WHEN {row}.initial = '{role}' AND {fine} THEN {extra} ELSE 99999999 END", "K")]
        if role != "s":
            ways.append(_with(source, f"CASE WHEN {fine} THEN 3 + {extra} ELSE 99999999 END", "R"))
        return ", ".join(ways)

    return {
        "n": delete["n"], "s": f"list_min([{delete['s']}, {stay('n', 's')}])",
        "u": f"list_min([{delete['u']}, {', '.join(stay(q, 'u') for q in 'nsa')}])",
        "a": f"list_min([{delete['a']}, {stay('u', 'a')}])",
    }


_OWN = _own("r")
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
    lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384)
    ELSE s >> 1 END, xor(c, b)), 4294967295), 4294967295) % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN ''
    WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1:] AS tail, lag(role[1:1]) OVER w || role[1:1] AS pair
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
r AS MATERIALIZED (SELECT conv_id, i, turn, role, text, role[1:1] AS initial, pair, tail = '' AS blank, tail <> '' AND again AS dup,
    tail <> '' AND NOT again AND tail NOT IN ('.', '!', '?') AS trunc FROM ordered),
counts AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 't': ''}} AS n, {{'c': CAST(99999999 AS BIGINT), 't': ''}} AS s,
    {{'c': CAST(3 AS BIGINT), 't': 'I'}} AS u, {{'c': CAST(6 AS BIGINT), 't': 'II'}} AS a FROM counts
  UNION ALL
  SELECT conv_id, i, n, s, u, list_min([a, {_with('u', '3', 'I')}]) FROM (
    SELECT conv_id, i, n, s, list_min([u, {_with('n', '3', 'I')}, {_with('s', '3', 'I')}, {_with('a', '3', 'I')}]) AS u, a FROM (
      SELECT dp.conv_id, r.i, {_OWN['n']} AS n, {_OWN['s']} AS s, {_OWN['u']} AS u, {_OWN['a']} AS a
      FROM dp JOIN r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND dp.i + 1 = r.i))),
best AS MATERIALIZED (SELECT dp.conv_id, list_min([n, a]) AS b FROM dp JOIN counts c ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.rows),
letters AS (SELECT conv_id, j, letter, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) AS m
    FROM (SELECT conv_id, j, b.t[j:j] AS letter FROM (SELECT conv_id, b, unnest(range(1, length(b.t) + 1)) AS j FROM best))
    WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
fixed AS (SELECT l.conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN r.role ELSE CASE (m - o) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE letter WHEN 'I' THEN '' ELSE r.text END, chr(10) ORDER BY j)) AS digest
    FROM letters l LEFT JOIN r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i WHERE letter <> 'D' GROUP BY l.conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.t, '') AS audit,
    coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN fixed f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
"""

URL_FILTERS = r"""
WITH captures AS (SELECT row_number() OVER () AS n, page_id, DATE '2024-01-01' + CAST(page_id * 7 % 366 AS INTEGER) AS fetched,
    nullif(regexp_replace(translate(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.|\.$', '', 'g'), '') AS host FROM pages),
looked AS (SELECT n, fetched, depth, array_to_string(labels[depth + 1:], '.') AS key FROM (
    SELECT n, fetched, labels, unnest(range(greatest(len(labels) - 1, 1))) AS depth FROM (
      SELECT n, fetched, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL))),
keys AS (SELECT key, CAST('0x' || m[1:2] AS INTEGER) AS a, CAST('0x' || m[3:4] AS INTEGER) AS b, CAST('0x' || m[5:6] AS INTEGER) AS c,
    CAST('0x' || m[7:7] AS INTEGER) AS d FROM (SELECT DISTINCT key, md5(key) AS m FROM looked)),
dated AS (SELECT *, DATE '2024-01-01' + b % 180 AS added FROM keys),
entries AS (
    SELECT key, 'spam' AS list, 'block' AS kind, added AS day, 'add' AS action FROM dated WHERE a < 64
    UNION ALL SELECT key, 'spam', 'block', added + (20 + c % 60), 'remove' FROM dated WHERE a < 64 AND d < 12
    UNION ALL SELECT key, 'spam', 'block', added + (100 + c % 60), 'add' FROM dated WHERE a < 64 AND d < 6
    UNION ALL SELECT key, 'malware', 'block', added + 10, 'add' FROM dated WHERE a < 64 AND d > 8
    UNION ALL SELECT key, 'trusted', 'allow', added + 5, 'add' FROM dated WHERE c < 24),
daily AS (SELECT list, kind, key, day, max(action) AS action FROM entries GROUP BY ALL),
changes AS (SELECT * FROM (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY list, kind, key ORDER BY day) AS before FROM daily) WHERE action <> before),
spans AS (SELECT list, kind, key, day AS valid_from, action, coalesce(lead(day) OVER (PARTITION BY list, kind, key ORDER BY day), DATE '9999-12-31') AS valid_to FROM changes),
hits AS (SELECT n, count(*) AS n_active, min({'depth': depth, 'kind': kind, 'list': list, 'key': l.key, 'valid_from': valid_from}) AS m
    FROM looked l JOIN spans s ON l.key = s.key AND s.action = 'add' AND l.fetched >= s.valid_from AND l.fetched < s.valid_to GROUP BY n)
SELECT page_id, host, coalesce(n_active, 0) AS n_active, m.list AS list, m.key AS key, strftime(m.valid_from, '%Y-%m-%d') AS valid_from,
    coalesce(m.kind = 'block', false) AS blocked
FROM captures c LEFT JOIN hits h ON c.n = h.n
"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op4_url_filters": URL_FILTERS,
    "op5_decontamination": DECONTAMINATION,
    "op8_minhash": NEAR_DUPLICATES,
    "op11_chat_format": CHAT_FORMAT,
    "op12_vector_codes": VECTOR_CODES,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
