"""DuckDB SQL for every registered query: an independent, brute-force
statement of the same result over the same test tables (the binding views
are shared text; the operator logic is written again in SQL).
"""

from __future__ import annotations

from chatweave.functions.text import (
    digit_class,
    portable_non_word_run,
    portable_word_char,
    whitespace_class,
)
from chatweave.operators.search import INTERVAL, PROJECTIONS, projection
from chatweave.plans import catalog as C
from chatweave.sources.testdata import binding_ctes

BIND = binding_ctes()
DIGITS = digit_class()
# Fixed value: the rule for links, stated from its parts: a scheme, then letters, digits,
# the listed signs, or percent escapes (a percent sign is one of "$" to "_").
LINK_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_]|[!]|[ ]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
WS = whitespace_class()
WORD = portable_word_char()
NON_WORD = portable_non_word_run()
BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"

ADDR = f"""
addr AS (
  SELECT chat_key, member_pos, name,
         CAST(row_number() OVER (PARTITION BY chat_key, member_pos ORDER BY addr_pos) - 1 AS INTEGER) AS addr_pos,
         raw_address,
         CASE WHEN contains(raw_address, '@') THEN raw_address
              ELSE regexp_replace(raw_address, '[^{DIGITS}]', '', 'g') END AS address
  FROM contact_rows),
addr_status AS (
  SELECT *, CASE WHEN contains(raw_address, '@') THEN 'ok'
                 WHEN length(address) < 10 THEN 'too short'
                 WHEN length(address) > 15 THEN 'too long' ELSE 'ok' END AS status
  FROM addr),
valid AS (SELECT * FROM addr_status WHERE status = 'ok'),
ch AS (
  SELECT v.chat_key, v.member_pos, v.name, v.addr_pos, v.address, h.rowid AS handle_id
  FROM valid v JOIN handle h ON h.id ILIKE '%' || v.address || '%'),
gids AS (
  SELECT c.chat_key, t.rowid AS chat_id
  FROM chats c JOIN chat t ON t.display_name = c.display_name WHERE c.kind = 'group'),
iids AS (
  SELECT v.chat_key, v.addr_pos, v.address, t.rowid AS chat_id
  FROM valid v JOIN chats c ON c.chat_key = v.chat_key AND c.kind = 'individual'
  JOIN chat t ON t.chat_identifier ILIKE '%' || v.address || '%'),
ids AS (
  SELECT DISTINCT chat_key, 'group' AS kind, chat_id FROM gids
  UNION SELECT DISTINCT chat_key, 'individual' AS kind, chat_id FROM iids),
other AS (
  SELECT cr.chat_key, arg_min(cr.name, cr.member_pos) AS other_name
  FROM contact_rows cr JOIN chats c ON c.chat_key = cr.chat_key AND c.kind = 'individual'
  GROUP BY cr.chat_key),
smap AS (
  SELECT chat_key, handle_id, arg_max(name, member_pos) AS member_name FROM (
    SELECT ch.chat_key, ch.handle_id, ch.name, ch.member_pos
    FROM ch JOIN chats c ON c.chat_key = ch.chat_key AND c.kind = 'group'
    UNION ALL
    SELECT chat_key, CAST(0 AS BIGINT), user_name, -1 FROM chats WHERE kind = 'group') t
  GROUP BY chat_key, handle_id)"""


def _labelled(since: int | None = None) -> str:
    cond = f" AND m.date > {since}" if since is not None else ""
    return f"""
lm AS (
  SELECT l.chat_key, l.kind, c.user_name, o.other_name, m.rowid AS message_id, m.handle_id,
         m.is_from_me, m.text, m.date AS time, m.associated_message_type AS type
  FROM message m
  JOIN chat_message_join j ON j.message_id = m.rowid
  JOIN ids l ON l.chat_id = j.chat_id
  JOIN chats c ON c.chat_key = l.chat_key
  LEFT JOIN other o ON o.chat_key = l.chat_key
  WHERE m.text IS NOT NULL AND m.date IS NOT NULL AND m.associated_message_type IS NOT NULL{cond}
    AND ((l.kind = 'group' AND m.handle_id IS NOT NULL)
         OR (l.kind = 'individual' AND m.is_from_me IS NOT NULL))),
labelled AS (
  SELECT lm.*, s.member_name, h.id AS handle_address,
         CASE WHEN lm.kind = 'individual'
              THEN CASE WHEN lm.is_from_me = 1 THEN lm.user_name ELSE lm.other_name END
              ELSE coalesce(nullif(s.member_name, ''), h.id, 'unknown:' || CAST(lm.handle_id AS VARCHAR))
         END AS sender
  FROM lm
  LEFT JOIN smap s ON s.chat_key = lm.chat_key AND s.handle_id = lm.handle_id
  LEFT JOIN handle h ON h.rowid = lm.handle_id),
loaded AS (SELECT chat_key, message_id, sender, text, time, type FROM labelled)"""


LOADED = f"WITH {BIND},{ADDR},{_labelled()}"
OUT = "chat_key, message_id, sender, text, time, type"
CLEAN = f"""
cleaned AS (
  SELECT * FROM (
    SELECT chat_key, message_id, sender, regexp_replace(text, '{LINK_PATTERN}', '', 'g') AS text, time, type
    FROM loaded WHERE type = 0)
  WHERE regexp_matches(text, '{WORD}'))"""
LINES = f"""
lines AS (
  SELECT chat_key, CAST(0 AS BIGINT) AS batch_id, time, message_id,
         regexp_replace(regexp_replace(sender || ': ' || text, '{BREAK}\\z', ''), '{BREAK}', ' ', 'g') AS line
  FROM cleaned)"""

SESSIONS = f"""
parted AS (
  SELECT *, CAST(sum(CASE WHEN time - earlier > {C.SILENCE} THEN 1 ELSE 0 END) OVER (
    PARTITION BY chat_key, batch_id ORDER BY time, message_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
  FROM (SELECT *, lag(time) OVER (PARTITION BY chat_key, batch_id ORDER BY time, message_id) AS earlier FROM lines))"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _greedy(src: str = "lines", out: str = "chunks") -> str:
    """Greedy packing as one left fold per (chat, batch)."""
    pieces = (
        "list_reduce(list_transform(flatten(list_transform(string_split(x, ' '), lambda w: "
        "CASE WHEN length(w) = 0 THEN [''] ELSE list_transform(range(0, length(w), 1000), "
        "lambda i: substr(w, i + 1, 1000)) END)), lambda p: p), "
        "lambda acc, p: CASE WHEN acc.first THEN struct_pack(first := false, l := [p]) "
        "WHEN length(acc.l[-1]) + 1 + length(p) <= 1000 "
        "THEN struct_pack(first := false, l := acc.l[:-2] || [acc.l[-1] || ' ' || p]) "
        "ELSE struct_pack(first := false, l := acc.l || [p]) END, "
        "struct_pack(first := true, l := []::VARCHAR[])).l"
    )
    fold = (
        "list_reduce(ls, lambda acc, x: "
        f"CASE WHEN length(x) > 1000 THEN struct_pack(c := acc.c || (CASE WHEN acc.h THEN [acc.o] ELSE []::VARCHAR[] END) || {pieces}, o := '', h := false) "
        "WHEN NOT acc.h THEN struct_pack(c := acc.c, o := x, h := true) "
        "WHEN length(acc.o) + 1 + length(x) <= 1000 THEN struct_pack(c := acc.c, o := acc.o || chr(10) || x, h := true) "
        "ELSE struct_pack(c := acc.c || [acc.o], o := x, h := true) END, "
        "struct_pack(c := []::VARCHAR[], o := '', h := false))"
    )
    return f"""
grouped AS (
  SELECT chat_key, batch_id, list(line ORDER BY time, message_id) AS ls FROM {src} GROUP BY chat_key, batch_id),
folded AS (
  SELECT chat_key, batch_id, f.c || (CASE WHEN f.h THEN [f.o] ELSE []::VARCHAR[] END) AS cs
  FROM (SELECT chat_key, batch_id, {fold} AS f FROM grouped)),
{out} AS (
  SELECT chat_key, batch_id, CAST(n - 1 AS BIGINT) AS chunk_no, {_strip('t')} AS text
  FROM (SELECT chat_key, batch_id, unnest(cs) AS t, unnest(generate_series(1, len(cs))) AS n FROM folded)
  WHERE {_strip('t')} <> '')"""


def _embed(src: str, key: str, text: str, out: str) -> str:
    return f"""
{out}_tok AS (
  SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '{NON_WORD}'), lambda w: w <> '') AS ws FROM {src}),
{out}_cnt AS (
  SELECT {key}, list_transform(range(0, 64), lambda i: CAST(len(list_filter(
      list_transform(ws, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64), lambda b: b = i)) AS DOUBLE)) AS cnt
  FROM {out}_tok),
{out} AS (
  SELECT {key}, list_transform(cnt, lambda x: CAST(CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END AS FLOAT)) AS embedding
  FROM (SELECT *, sqrt(list_reduce(cnt, lambda a, x: a + x * x, 0.0::DOUBLE)) AS nrm FROM {out}_cnt))"""


def _dist(a: str, b: str) -> str:
    return (
        f"sqrt(list_reduce(list_transform(list_zip({a}, {b}), lambda z: "
        f"(z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)), lambda s, v: s + v, 0.0::DOUBLE))"
    )


def _norm(v: str) -> str:
    return (
        f"list_transform({v}, lambda x: CAST(CASE WHEN sqrt(list_reduce({v}, lambda a, y: a + y::DOUBLE * y::DOUBLE, 0.0::DOUBLE)) > 0 "
        f"THEN x::DOUBLE / sqrt(list_reduce({v}, lambda a, y: a + y::DOUBLE * y::DOUBLE, 0.0::DOUBLE)) ELSE 0.0 END AS FLOAT))"
    )


CHUNK_VECTORS = f"""{CLEAN},{LINES},{_greedy()},{_embed('chunks', 'chat_key, batch_id, chunk_no, text', 'text', 'chunk_vectors')}"""

CONTEXTS = f"""
questions AS (SELECT DISTINCT message_id AS query_id, chat_key, text AS query FROM loaded WHERE sender = 'You'),
{_embed('questions', 'query_id, chat_key, query', 'query', 'qvec')},
hits AS (
  SELECT q.query_id, cv.text,
         q.chat_key, row_number() OVER (PARTITION BY q.query_id, q.chat_key ORDER BY {_dist('q.embedding', 'cv.embedding')}, cv.batch_id, cv.chunk_no) AS rk
  FROM qvec q JOIN chunk_vectors cv ON cv.chat_key = q.chat_key
  QUALIFY rk <= {C.TOP_K}),
contexts AS (
  SELECT q.query_id, q.chat_key, q.query,
         coalesce((SELECT string_agg(h.text, chr(10) || '###' || chr(10) ORDER BY h.rk) FROM hits h
                   WHERE h.query_id = q.query_id AND h.chat_key = q.chat_key), '') AS context
  FROM questions q)"""


def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE), lambda s, v: s + v, 0.0::DOUBLE)"


def _topk(metric: str) -> str:
    if metric == "l2":
        distance, extra = _dist("q.embedding", "i.embedding"), ""
    else:  # a zero vector stays zero, so its similarity is 0
        distance, extra = f"1.0 - {_dot('q.nv', 'i.nv')}", ", 1.0 - distance AS similarity"
    return f"""
WITH e AS (SELECT vec_id, label, embedding, {_norm('embedding')} AS nv FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, q.label, i.vec_id, {distance} AS distance
  FROM e q JOIN e i ON q.label = i.label)
SELECT query_id, label, vec_id, rank, distance{extra} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= {C.TOP_K}"""


def _lsh() -> str:
    """Pairs that share an interval on some projection, then the nearest."""
    lines = ", ".join("[" + ", ".join(f"{c!r}::DOUBLE" for c in projection(t, C.VECTOR_DIM)) + "]" for t in range(PROJECTIONS))
    return f"""
WITH e AS (
  SELECT vec_id, label, embedding, list_transform([{lines}], lambda l: CAST(floor({_dot('embedding', 'l')} / {INTERVAL}) AS BIGINT)) AS b
  FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, q.label, i.vec_id, {_dist('q.embedding', 'i.embedding')} AS distance
  FROM e q JOIN e i ON q.label = i.label AND ({' OR '.join(f'q.b[{t + 1}] = i.b[{t + 1}]' for t in range(PROJECTIONS))}))
SELECT query_id, label, vec_id, rank, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= {C.TOP_K}"""


SLUG = f"""
WITH {BIND},
names AS (SELECT DISTINCT name FROM (
  SELECT chat_key AS name FROM chats UNION ALL SELECT c_name FROM customer
  UNION ALL SELECT p_name FROM part UNION ALL SELECT props FROM events
  UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents)),
s AS (SELECT name, regexp_replace(regexp_replace(name, '[{WS}]+', '_', 'g'), '{NON_WORD}', '', 'g') AS slug FROM names)
SELECT name, CASE WHEN slug = '' THEN substr(sha256(name), 1, 16) ELSE slug END AS chat_slug FROM s"""

BATCHED = f"""
batched AS (
  SELECT *, CAST(CASE WHEN time <= {C.SPLIT_TIME} THEN 1 ELSE 2 END AS BIGINT) AS batch_id FROM cleaned)"""

SLUG_COL = (
    f"CASE WHEN regexp_replace(regexp_replace(chat_key, '[{WS}]+', '_', 'g'), '{NON_WORD}', '', 'g') = '' "
    f"THEN substr(sha256(chat_key), 1, 16) "
    f"ELSE regexp_replace(regexp_replace(chat_key, '[{WS}]+', '_', 'g'), '{NON_WORD}', '', 'g') END"
)

NEWEST_FIRST = "CAST(row_number() OVER (ORDER BY time DESC, message_id DESC) AS BIGINT) AS rank"

ORACLES: dict[str, str] = {
    "scan_messages": f"""WITH {BIND}
SELECT rowid AS message_id, handle_id, is_from_me, text, date AS time, associated_message_type AS type FROM message""",
    "drop_incomplete": f"""WITH {BIND}
SELECT rowid AS message_id, handle_id, is_from_me, text, date AS time, associated_message_type AS type FROM message
WHERE handle_id IS NOT NULL AND text IS NOT NULL AND date IS NOT NULL AND associated_message_type IS NOT NULL""",
    "messages_since": f"WITH {BIND},{ADDR},{_labelled(C.SINCE)} SELECT {OUT} FROM loaded",
    "message_index": f"""{LOADED}
SELECT chat_key, message_id, time,
       CAST(row_number() OVER (PARTITION BY chat_key ORDER BY time, message_id) - 1 AS BIGINT) AS idx FROM loaded""",
    "contact_addresses": f"WITH {BIND},{ADDR} SELECT chat_key, member_pos, name, addr_pos, raw_address FROM addr",
    "clean_addresses": f"WITH {BIND},{ADDR} SELECT chat_key, member_pos, name, addr_pos, raw_address, address, status FROM addr_status",
    "contact_handles": f"WITH {BIND},{ADDR} SELECT chat_key, member_pos, name, addr_pos, address, handle_id FROM ch",
    "chat_ids_group": f"WITH {BIND},{ADDR} SELECT chat_key, chat_id FROM gids",
    "chat_ids_individual": f"WITH {BIND},{ADDR} SELECT chat_key, addr_pos, address, chat_id FROM iids",
    "unresolved_addresses": f"""WITH {BIND},{ADDR}
SELECT chat_key, member_pos, name, addr_pos, raw_address, address, status AS reason FROM addr_status WHERE status <> 'ok'
UNION ALL
SELECT v.chat_key, v.member_pos, v.name, v.addr_pos, v.raw_address, v.address, 'not found' AS reason FROM valid v
WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.chat_key = v.chat_key AND ch.member_pos = v.member_pos AND ch.addr_pos = v.addr_pos)""",
    "unresolved_chats": f"""WITH {BIND},{ADDR}
SELECT c.chat_key, 'group' AS kind, CAST(NULL AS INTEGER) AS addr_pos, c.display_name AS detail
FROM chats c WHERE c.kind = 'group' AND NOT EXISTS (SELECT 1 FROM gids g WHERE g.chat_key = c.chat_key)
UNION ALL
SELECT v.chat_key, 'individual' AS kind, v.addr_pos, v.address AS detail
FROM valid v JOIN chats c ON c.chat_key = v.chat_key AND c.kind = 'individual'
WHERE NOT EXISTS (SELECT 1 FROM iids i WHERE i.chat_key = v.chat_key AND i.addr_pos = v.addr_pos)""",
    "load_group": f"{LOADED} SELECT {OUT} FROM labelled WHERE kind = 'group'",
    "load_individual": f"{LOADED} SELECT {OUT} FROM labelled WHERE kind = 'individual'",
    "load_messages": f"{LOADED} SELECT {OUT} FROM loaded",
    "unknown_senders": f"""{LOADED}
SELECT chat_key, handle_id, address, f.t AS first_time, f.m AS first_message_id, n_messages FROM (
  SELECT chat_key, handle_id, min(sender) AS address, min(struct_pack(t := time, m := message_id)) AS f,
         count(*) AS n_messages
  FROM labelled WHERE kind = 'group' AND (member_name IS NULL OR member_name = '')
  GROUP BY chat_key, handle_id)""",
    "chat_slug": SLUG,
    "rule_standard_only": f"{LOADED} SELECT {OUT} FROM loaded WHERE type = 0",
    "rule_has_word": f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, text FROM (
  SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(text, ' ') AS ls FROM documents))
WHERE regexp_matches(text, '{WORD}')""",
    "rule_remove_links": f"""
SELECT page_id, regexp_replace('see ' || url || ' ok' || chr(10) || html, '{LINK_PATTERN}', '', 'g') AS text FROM pages""",
    "rule_remove_member": f"{LOADED} SELECT {OUT} FROM loaded WHERE sender <> '{C.RULE_MEMBER}'",
    "rule_reverse_order": f"{LOADED} SELECT {OUT}, {NEWEST_FIRST} FROM loaded",
    "apply_rules": f"{LOADED} SELECT {OUT}, {NEWEST_FIRST} FROM loaded WHERE sender <> '{C.RULE_MEMBER}'",
    "default_clean": f"{LOADED},{CLEAN} SELECT {OUT} FROM cleaned",
    "format_lines": f"{LOADED},{CLEAN},{LINES} SELECT chat_key, batch_id, time, message_id, line FROM lines",
    "join_texts": f"""{LOADED},{CLEAN},{LINES}
SELECT chat_key, batch_id, time, message_id,
       CAST(row_number() OVER w - 1 AS BIGINT) AS line_no,
       CAST(coalesce(sum(length(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset,
       line
FROM lines WINDOW w AS (PARTITION BY chat_key, batch_id ORDER BY time, message_id)""",
    "join_pages": f"""{LOADED},{CLEAN},{LINES},
joined AS (SELECT chat_key, batch_id, string_agg(line, chr(10) ORDER BY time, message_id) AS t FROM lines GROUP BY chat_key, batch_id)
SELECT chat_key, batch_id, page_no::BIGINT AS page_no, substr(t, (page_no * {C.PAGE_CHARS} + 1)::BIGINT, {C.PAGE_CHARS}) AS text
FROM (SELECT *, unnest(range(0, ((length(t) + {C.PAGE_CHARS - 1}) // {C.PAGE_CHARS})::BIGINT)) AS page_no FROM joined)""",
    "sessions": f"""{LOADED},{CLEAN},{LINES},{SESSIONS}
SELECT chat_key, batch_id, session_no, min(time) AS first_time, max(time) AS last_time, count(*) AS n_lines FROM parted GROUP BY ALL""",
    "chunk_session": f"""{LOADED},{CLEAN},{LINES},{SESSIONS},
renamed AS (SELECT chat_key, session_no AS batch_id, time, message_id, line FROM parted),
{_greedy('renamed')} SELECT chat_key, CAST(0 AS BIGINT) AS batch_id, batch_id AS session_no, chunk_no, text FROM chunks""",
    "chunk_grid": f"""{LOADED},{CLEAN},{LINES},
off AS (
  SELECT *, CAST(row_number() OVER w AS BIGINT) AS line_no,
         CAST(coalesce(sum(length(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
  FROM lines WINDOW w AS (PARTITION BY chat_key, batch_id ORDER BY time, message_id))
SELECT chat_key, batch_id, chunk_no, text FROM (
  SELECT chat_key, batch_id, CAST(floor("offset" / 1000) AS BIGINT) AS chunk_no,
         {_strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text
  FROM off GROUP BY chat_key, batch_id, CAST(floor("offset" / 1000) AS BIGINT))
WHERE text <> ''""",
    "chunk_greedy": f"{LOADED},{CLEAN},{LINES},{_greedy()} SELECT chat_key, batch_id, chunk_no, text FROM chunks",
    "embed_hashed": f"WITH {_embed('documents', 'doc_id', 'text', 'emb')} SELECT doc_id, embedding FROM emb",
    "similarity_topk": _topk("l2"),
    "similarity_topk_cosine": _topk("cosine"),
    "similarity_lsh": _lsh(),
    "index_search": _topk("l2"),
    "index_search_cosine": _topk("cosine"),
    "index_build": f"{LOADED},{CHUNK_VECTORS} SELECT chat_key, batch_id, chunk_no, text, embedding FROM chunk_vectors",
    "generate_context": f"{LOADED},{CHUNK_VECTORS},{CONTEXTS} SELECT query_id, chat_key, query, context FROM contexts",
    "retrieval_log": f"{LOADED},{CHUNK_VECTORS},{CONTEXTS} SELECT query_id, chat_key, query, context FROM contexts",
    "high_water_mark": f"""{LOADED}
SELECT chat_key, f.t AS mark_time, f.m AS mark_id FROM (
  SELECT chat_key, max(struct_pack(t := time, m := message_id)) AS f FROM loaded GROUP BY chat_key)""",
    "save_messages": f"""{LOADED},{CLEAN},{BATCHED}
SELECT {OUT}, {SLUG_COL} AS chat_slug, batch_id FROM batched""",
    "incremental_ingest": f"""{LOADED},{CLEAN},{BATCHED}
SELECT {OUT}, {SLUG_COL} AS chat_slug, batch_id FROM batched""",
    "incremental_stream": f"""{LOADED},{CLEAN},{BATCHED}
SELECT {OUT}, {SLUG_COL} AS chat_slug, batch_id FROM batched""",
    "index_append": f"""{LOADED},{CLEAN},{BATCHED},
lines AS (
  SELECT chat_key, batch_id, time, message_id,
         regexp_replace(regexp_replace(sender || ': ' || text, '{BREAK}\\z', ''), '{BREAK}', ' ', 'g') AS line
  FROM batched),
{_greedy()},{_embed('chunks', 'chat_key, batch_id, chunk_no, text', 'text', 'chunk_vectors')}
SELECT chat_key, batch_id, chunk_no, text, embedding FROM chunk_vectors""",
    "late_rows": f"{LOADED},{CLEAN} SELECT {OUT} FROM cleaned",
    "late_links_stream": f"{LOADED},{CLEAN} SELECT {OUT} FROM cleaned",
    "ordered_export": f"""{LOADED},{CLEAN}
SELECT row_number() OVER (ORDER BY chat_slug, chat_key, time, message_id) AS rank, * FROM (SELECT {SLUG_COL} AS chat_slug, {OUT} FROM cleaned)""",
    "read_chat": f"""{LOADED},{CLEAN},
slugged AS (SELECT {SLUG_COL} AS chat_slug, {OUT} FROM cleaned)
SELECT * FROM slugged WHERE chat_slug = (SELECT chat_slug FROM slugged GROUP BY chat_slug ORDER BY count(*) DESC, chat_slug LIMIT 1)""",
    "csv_roundtrip": f"{LOADED},{CLEAN} SELECT {OUT} FROM cleaned",
}


def _system_literal() -> str:
    from chatweave.operators.retrieval import SYSTEM_PROMPT

    return SYSTEM_PROMPT.replace("'", "''")


SETTINGS = "0.7::DOUBLE AS temperature, 0.3::DOUBLE AS frequency_penalty, 500 AS max_tokens"
ORACLES["build_prompts"] = f"""{LOADED},{CHUNK_VECTORS},{CONTEXTS}
SELECT query_id, chat_key, 0 AS msg_pos, 'system' AS role, '{_system_literal()}' AS content, {SETTINGS} FROM contexts
UNION ALL
SELECT query_id, chat_key, 1 AS msg_pos, 'user' AS role,
       'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query AS content, {SETTINGS} FROM contexts"""
ORACLES["stream_index"] = ORACLES["index_append"]
# the same results by maintained state
for _name, _of in (
    ("contact_handles_delta", "contact_handles"), ("unknown_senders_stream", "unknown_senders"), ("high_water_mark_stream", "high_water_mark"),
    ("committed_messages", "incremental_ingest"), ("committed_vectors", "index_append"),
):
    ORACLES[_name] = ORACLES[_of]
