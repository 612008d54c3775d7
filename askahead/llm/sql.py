"""DuckDB SQL that gives the rows of the queries that SQL can express."""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(len(w) - n + 1)) t(i)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g
       FROM d, sizes, unnest(range(greatest(len(w) - n + 1, 0))) t(i)),
occ AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, pos, line,
                  {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
           FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
common AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, coalesce(keeper <> doc_id, false) AS gone FROM l LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, {_LOWER.format("text")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

_CHARS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
# Base32 of 20 bytes: each five hexadecimal digits are four letters of five bits.
_GROUPS = ", ".join(
    f"substr({_CHARS}, 1 + ((('0x' || substr(sha, {5 * g + 1}, 5))::INTEGER >> {s}) & 31)::INTEGER, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)

WARC = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, concat({_GROUPS}) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_WHITE = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WHITE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g
      FROM w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(reach.b), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""

_ROW_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _then(cost: str, edit: str, line: str, state: str) -> str:
    """The label of a state, with one more edit in front; null stays null."""
    return (
        f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'e': '{edit}' || {state}.e, "
        f"'l': {f'list_prepend({line}, {state}.l)' if line else f'{state}.l'}}} END"
    )


def _step(state: str) -> str:
    """The label of a state one row earlier, without inserts: delete, reassign or keep the row."""
    given = "a" if state == "u" else "u"
    role = "assistant" if given == "a" else "user"
    extra = "CASE WHEN cut THEN 5 ELSE 0 END"
    stays = "NOT blank AND NOT dup"
    options = [_then("2", "D", "", state), f"CASE WHEN {stays} THEN {_then(f'1 + {extra}', 'R', chr(39) + role + ':' + chr(39) + ' || text', given)} END"]
    for initial, to in {"z": [("s", "s"), ("u", "u")], "s": [("u", "u")], "u": [("a", "a")], "a": [("u", "u")]}[state]:
        kept = _then(extra, "K", "role || ':' || text", to)
        options.append(f"CASE WHEN {stays} AND r = '{initial}' THEN {kept} END")
    return f"list_min([{', '.join(options)}])"


# Labels (cost, edits, lines) of the states nothing, system, user and assistant, from each conversation's end backwards.
CONVERSATIONS = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, crc),
h AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, copy,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM f, unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) u(copy)),
o AS (SELECT *, rtrim(text, {_ROW_WHITE}) AS core, left(role, 1) AS r,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM h),
m AS (SELECT *, core = '' AS blank,
             core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
             i > 1 AND ((lag(r) OVER w) || r) NOT IN ('su', 'ua', 'au') AS wrong
      FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
n AS MATERIALIZED (SELECT *, NOT blank AND NOT dup AND right(core, 1) NOT IN ('.', '!', '?') AS cut FROM m),
done(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, max(i), {{'c': 0::BIGINT, 'e': '', 'l': []::VARCHAR[]}}, {{'c': 10::BIGINT, 'e': 'II', 'l': ['user:', 'assistant:']}},
         {{'c': 5::BIGINT, 'e': 'I', 'l': ['assistant:']}}, {{'c': 0::BIGINT, 'e': '', 'l': []::VARCHAR[]}}
  FROM n GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_min([z, {_then("5", "I", "'user:'", "u")}]), list_min([s, {_then("5", "I", "'user:'", "u")}]), u, a
  FROM (SELECT conv_id, i, z, s, list_min([u, {_then("5", "I", "'assistant:'", "a")}]) AS u,
               list_min([a, {_then("5", "I", "'user:'", "u")}]) AS a
        FROM (SELECT done.conv_id, done.i - 1 AS i, {_step("z")} AS z, {_step("s")} AS s, {_step("u")} AS u, {_step("a")} AS a
              FROM done JOIN n ON n.conv_id IS NOT DISTINCT FROM done.conv_id AND n.i = done.i))),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (dup) AS dup, count(*) FILTER (cut) AS cut, count(*) FILTER (wrong) AS wrong
  FROM n GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(dup, 0) AS duplicate,
       coalesce(cut, 0) AS truncated, coalesce(wrong, 0) AS illegal, coalesce(z.c, 0) AS cost, coalesce(z.e, '') AS audit,
       sha256(coalesce(array_to_string(z.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id AND done.i = 0
"""
