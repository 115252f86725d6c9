"""DuckDB SQL oracles, one per registered query (same column names)."""

from __future__ import annotations

from .. import config as C
from .sqltext import LINE_BREAK, NL, NON_WS, WORD_RE2, WS_SQL, lit

S = lit(C.START_MARKER)
E = lit(C.END_MARKER)

SCRIPTS = f"""
scripts AS (
  SELECT conv_id,
         string_agg(upper(role) || '.' || {NL} || text, {NL} || {NL} ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id),
stripped AS (SELECT conv_id, trim(text, {WS_SQL}) AS t FROM scripts),
lines AS (
  SELECT conv_id, unnest(regexp_split_to_array(t, {lit(LINE_BREAK)})) AS line,
         generate_subscripts(regexp_split_to_array(t, {lit(LINE_BREAK)}), 1) AS n
  FROM stripped WHERE t <> ''),
flags AS (
  SELECT *, CASE WHEN regexp_matches(line, {lit(NON_WS)}) THEN 0 ELSE 1 END AS blank FROM lines),
runs AS (
  SELECT *, sum(blank) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) - blank AS run
  FROM flags),
lens AS (
  SELECT *, sum(1 - blank) OVER (PARTITION BY conv_id, run) AS run_len FROM runs),
marked AS (
  SELECT conv_id,
         string_agg(CASE WHEN blank = 1 AND run_len >= 3 THEN {E} || {NL} || {S} ELSE line END,
                    {NL} ORDER BY n) AS body,
         sum(CASE WHEN blank = 1 AND run_len >= 3 THEN 1 ELSE 0 END) AS n_closers
  FROM lens GROUP BY conv_id),
segmented AS (
  SELECT s.conv_id,
         CASE WHEN s.t = '' THEN {S} || {NL} || {E} || {NL}
              ELSE {S} || {NL} || m.body || {NL} || {E} || {NL} END AS segmented,
         coalesce(m.n_closers, 0) + 1 AS n_segments
  FROM stripped s LEFT JOIN marked m USING (conv_id))"""

SEGMENTS = SCRIPTS + f""",
pieces AS (
  SELECT conv_id, list_filter(string_split(segmented, {S}),
                              lambda p: regexp_matches(p, {lit(NON_WS)})) AS ps
  FROM segmented),
segs AS (
  SELECT conv_id, (generate_subscripts(ps, 1) - 1)::BIGINT AS seg_id,
         {S} || {NL} || trim(unnest(ps), {WS_SQL}) AS body
  FROM pieces)"""


def split_cte(src: str, key_expr: str, order_cols: str) -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('{C.DEFAULT_SEED}:' || {key_expr}), {order_cols}) - 1 AS rk,
         count(*) OVER () AS n_all
  FROM {src}),
splitted AS (
  SELECT *, CASE WHEN rk < floor(n_all * {C.TRAIN_RATIO}::DOUBLE) THEN 'train'
                 WHEN rk < floor(n_all * {C.TRAIN_RATIO}::DOUBLE) + floor(n_all * {C.VAL_RATIO}::DOUBLE) THEN 'val'
                 ELSE 'test' END AS split
  FROM ranked)"""


ORACLES: dict[str, str] = {}

ORACLES["corpus_segments"] = f"""WITH {SCRIPTS}
SELECT conv_id, n_segments::BIGINT AS n_segments, length(segmented)::BIGINT AS n_chars, segmented
FROM segmented"""

ORACLES["segment_reload"] = f"""WITH {SEGMENTS}
SELECT conv_id, seg_id, body FROM segs"""

ORACLES["split_summary"] = f"""WITH {SEGMENTS},
{split_cte('segs', "conv_id || ':' || seg_id", 'conv_id, seg_id')}
SELECT split, count(*)::BIGINT AS n_segments, sum(length(body))::BIGINT AS n_chars,
       sum(len(regexp_extract_all(body, {lit(WORD_RE2)})))::BIGINT AS n_words
FROM splitted GROUP BY split"""

ORACLES["exact_split"] = f"""WITH {split_cte('documents', 'doc_id', 'doc_id')}
SELECT doc_id, split FROM splitted"""

ORACLES["skip_processed"] = """
SELECT doc_id, file_name, replace(file_name, '.txt', '_segmented.txt') AS out_name
FROM (SELECT doc_id, source || CASE WHEN doc_id % 7 = 0 THEN '_segmented' ELSE '' END || '.txt' AS file_name
      FROM documents)
WHERE NOT contains(file_name, 'segmented')"""

# ---------------------------------------------------------------- vocabularies and encoding
WORD_SPECIALS_SQL = ", ".join(lit(s) for s in C.WORD_SPECIALS)
SPECIAL_ROWS = " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS id, {lit(s)} AS token, true AS special"
    for i, s in enumerate(C.WORD_SPECIALS))
MARKER_ALT = "|".join(lit(s)[1:-1].replace("|", r"\|") for s in C.WORD_SPECIALS)

WORD_VOCAB = f"""
wtok AS (SELECT unnest(regexp_extract_all(text, {lit(WORD_RE2)})) AS token FROM documents),
wcnt AS (SELECT token, count(*) AS cnt FROM wtok WHERE token NOT IN ({WORD_SPECIALS_SQL}) GROUP BY token),
wrank AS (SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + {len(C.WORD_SPECIALS) - 1})::INTEGER AS id
          FROM wcnt),
vocab AS (
  {SPECIAL_ROWS}
  UNION ALL SELECT id, token, false AS special FROM wrank WHERE id < {C.WORD_VOCAB_LIMIT})"""


def encoded(src: str, keys: str, pattern: str) -> str:
    return f"""
pieces AS (
  SELECT {keys}, regexp_extract_all(text, {lit(MARKER_ALT + '|' + pattern)}) AS ts FROM {src}),
toks AS (
  SELECT {keys}, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM pieces),
enc AS (
  SELECT t.*, coalesce(v.id, {C.UNK_ID})::INTEGER AS id, coalesce(v.special, false) AS special,
         v.token AS vtok
  FROM toks t LEFT JOIN vocab v USING (token))"""


DIGEST = f"""
SELECT {{keys}}, count(e.pos)::BIGINT AS n_tokens,
       count(*) FILTER (WHERE e.id = {C.UNK_ID})::BIGINT AS n_unk,
       md5(coalesce(string_agg(e.id::VARCHAR, ',' ORDER BY e.pos), '')) AS ids_md5
FROM {{src}} s LEFT JOIN enc e USING ({{keys}}) GROUP BY {{keys}}"""

ORACLES["word_vocab"] = f"WITH {WORD_VOCAB}\nSELECT id, token, special FROM vocab"

ORACLES["char_vocab"] = f"""
WITH ch AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS token FROM documents
            WHERE true),
r AS (SELECT (row_number() OVER (ORDER BY token) + 2)::INTEGER AS id, token, false AS special
      FROM ch WHERE token NOT IN ({WORD_SPECIALS_SQL}))
{SPECIAL_ROWS} UNION ALL SELECT * FROM r"""

ORACLES["char_vocab_limited"] = f"""
WITH ch AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS token FROM documents),
k AS (SELECT token FROM ch WHERE token NOT IN ({WORD_SPECIALS_SQL})
      GROUP BY token ORDER BY count(*) DESC, token LIMIT 40),
r AS (SELECT (row_number() OVER (ORDER BY token) + 2)::INTEGER AS id, token, false AS special FROM k)
{SPECIAL_ROWS} UNION ALL SELECT * FROM r"""

ORACLES["word_encode"] = (f"WITH {WORD_VOCAB},{encoded('documents', 'doc_id', WORD_RE2)}"
                          + DIGEST.format(keys="doc_id", src="documents"))

MARKED = SCRIPTS + ",\nmarked_texts AS (SELECT conv_id, segmented AS text FROM segmented)"
ORACLES["marked_encode"] = (f"WITH {MARKED},{WORD_VOCAB},{encoded('marked_texts', 'conv_id', WORD_RE2).replace('pieces AS', 'mpieces AS').replace('FROM pieces', 'FROM mpieces')}"
                            + DIGEST.format(keys="conv_id", src="marked_texts"))

ORACLES["char_encode"] = f"""WITH
ch AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS token FROM documents),
vocab AS ({SPECIAL_ROWS} UNION ALL
  SELECT (row_number() OVER (ORDER BY token) + 2)::INTEGER AS id, token, false FROM ch
  WHERE token NOT IN ({WORD_SPECIALS_SQL})),
{encoded('documents', 'doc_id', '(?s).')}""" + DIGEST.format(keys="doc_id", src="documents")

ORACLES["decode_roundtrip"] = f"""WITH {WORD_VOCAB},{encoded('documents', 'doc_id', WORD_RE2)},
dec AS (SELECT doc_id, string_agg(vtok, ' ' ORDER BY pos) AS text FROM enc
        WHERE vtok IS NOT NULL AND NOT special GROUP BY doc_id)
SELECT doc_id, length(coalesce(d.text, ''))::BIGINT AS n_chars, md5(coalesce(d.text, '')) AS text_md5
FROM documents LEFT JOIN dec d USING (doc_id)"""

TURN_IDS = f"""WITH {WORD_VOCAB},{encoded('conversations', 'conv_id, turn', WORD_RE2)},
turns AS (SELECT c.conv_id, c.turn, count(e.pos)::INTEGER AS n,
                 coalesce(list(e.id ORDER BY e.pos) FILTER (WHERE e.pos IS NOT NULL), []) AS ids
          FROM conversations c LEFT JOIN enc e USING (conv_id, turn) GROUP BY c.conv_id, c.turn)"""

# every id of a prompt is in one of its windows; the pads stand in front of the first
ORACLES["left_pad"] = TURN_IDS + f""",
sized AS (SELECT *, greatest(1, (n + {C.CONTEXT_LENGTH - 1}) // {C.CONTEXT_LENGTH}) AS w FROM turns),
padded AS (SELECT conv_id, turn, n, w,
                  list_concat(list_transform(range(w * {C.CONTEXT_LENGTH} - n), lambda i: {C.PAD_ID}), ids) AS p FROM sized),
wins AS (SELECT *, unnest(range(w)) AS win FROM padded)
SELECT conv_id, turn, win::BIGINT AS win, n::BIGINT AS n_ids, {C.CONTEXT_LENGTH}::BIGINT AS n_padded,
       md5(array_to_string(p[win * {C.CONTEXT_LENGTH} + 1 : (win + 1) * {C.CONTEXT_LENGTH}], ',')) AS padded_md5
FROM wins"""

ORACLES["batch_pad"] = TURN_IDS + f""",
mx AS (SELECT conv_id, max(n) AS L FROM turns GROUP BY conv_id)
SELECT conv_id, turn, L::BIGINT AS n_padded,
       md5(array_to_string(list_concat(ids, list_transform(range(L - n), lambda i: {C.PAD_ID})), ',')) AS padded_md5
FROM turns JOIN mx USING (conv_id)"""

# ---------------------------------------------------------------- byte-level BPE
from .sqltext import UNI_WS   # noqa: E402

BYTE_RE2 = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + UNI_WS + r"\p{L}\p{N}\x01]+"
            r"|[" + UNI_WS + "]+")
SENTINEL_FIND = "([" + UNI_WS + "])([^" + UNI_WS + "])"
N_BPE_SPECIALS = len(C.BPE_SPECIALS)

BYTE_WORDS = f"""
dl AS (SELECT doc_id, string_split(nfc_normalize(text), {NL}) AS parts FROM documents),
dl2 AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM dl),
lines AS (SELECT CASE WHEN i < n THEN part || {NL} ELSE part END AS line FROM dl2
          WHERE i < n OR part <> ''),
sent AS (SELECT regexp_replace(line, {lit(SENTINEL_FIND)}, chr(1) || '\\1\\2', 'g') AS s FROM lines),
bw AS (SELECT unnest(regexp_extract_all(s, {lit(BYTE_RE2)})) AS word FROM sent),
words AS (SELECT word, count(*) AS cnt FROM bw GROUP BY word)"""

ALPHABET = BYTE_WORDS + f""",
wb AS (SELECT DISTINCT unnest(regexp_extract_all(hex(encode(word)), '..')) AS h FROM words),
bytes AS (SELECT ('0x' || h)::INTEGER AS byte FROM wb),
alphabet AS (
  SELECT byte, (row_number() OVER (ORDER BY CASE WHEN (byte BETWEEN 33 AND 126) OR (byte BETWEEN 161 AND 172)
                                             OR (byte BETWEEN 174 AND 255) THEN byte ELSE byte + 256 END)
                + {N_BPE_SPECIALS - 1})::INTEGER AS id
  FROM bytes)"""

SYMS = ALPHABET + """,
wbytes AS (SELECT word, cnt, unnest(regexp_extract_all(hex(encode(word)), '..')) AS h,
                  generate_subscripts(regexp_extract_all(hex(encode(word)), '..'), 1) AS i FROM words),
wid AS (SELECT w.word, w.cnt, w.i, a.id FROM wbytes w JOIN alphabet a ON a.byte = ('0x' || w.h)::INTEGER),
wsym AS (SELECT word, any_value(cnt) AS cnt, string_agg('<' || id || '>', '' ORDER BY i) AS sym
         FROM wid GROUP BY word)"""

ORACLES["byte_pretoken_counts"] = f"WITH {BYTE_WORDS}\nSELECT word, cnt::BIGINT AS count FROM words"

ORACLES["byte_alphabet"] = f"WITH {ALPHABET}\nSELECT id, byte FROM alphabet"

ORACLES["bpe_pair_counts"] = f"""WITH {SYMS.replace('wid AS', 'wid0 AS').replace('FROM wid GROUP', 'FROM wid0 GROUP')}
, wid AS (SELECT * FROM wid0)
SELECT a.id AS "left", b.id AS "right", sum(a.cnt)::BIGINT AS count
FROM wid a JOIN wid b ON a.word = b.word AND b.i = a.i + 1
GROUP BY a.id, b.id"""


def _merges_sql(k: int) -> str:
    parts = [SYMS + ",\nw0 AS (SELECT sym, cnt FROM wsym),\nbase AS (SELECT count(*) + "
             f"{N_BPE_SPECIALS} AS b FROM alphabet)"]
    sel = []
    for i in range(k):
        parts.append(f"""p{i} AS (
  SELECT split_part(pr, ',', 1)::INTEGER AS l, split_part(pr, ',', 2)::INTEGER AS r, sum(cnt) AS c
  FROM (SELECT unnest(list_transform(range(1, len(ids)), lambda j: ids[j] || ',' || ids[j + 1])) AS pr, cnt
        FROM (SELECT string_split(trim(sym, '<>'), '><') AS ids, cnt FROM w{i}))
  GROUP BY pr),
m{i} AS (SELECT {i} AS rank, l, r, (SELECT b FROM base) + {i} AS out FROM p{i}
         ORDER BY c DESC, l, r LIMIT 1),
w{i + 1} AS (SELECT replace(sym, '<' || l || '><' || r || '>', '<' || out || '>') AS sym, cnt
          FROM w{i}, m{i})""")
        sel.append(f"SELECT * FROM m{i}")
    return ("WITH " + ",\n".join(parts) + "\nSELECT rank::INTEGER AS rank, l::INTEGER AS \"left\", "
            "r::INTEGER AS \"right\", out::INTEGER AS out FROM (" + " UNION ALL ".join(sel) + ")")


ORACLES["bpe_merges_8"] = _merges_sql(8)

# encoding loses nothing: decoding gives the NFC form back
ORACLES["bpe_decode"] = """
SELECT doc_id, length(nfc_normalize(text))::BIGINT AS n_chars, md5(nfc_normalize(text)) AS text_md5 FROM documents"""

ORACLES["segment_encode"] = f"""WITH {SCRIPTS},
bodies AS (
  SELECT conv_id, list_filter(list_transform(string_split(segmented, {S}), lambda p: trim(replace(p, {E}, ''), {WS_SQL})),
                              lambda p: p <> '') AS b FROM segmented)
SELECT conv_id, seg_id, 0 AS first_id, 1 AS last_id, md5(nfc_normalize(body)) AS text_md5
FROM (SELECT conv_id, unnest(b) AS body, (generate_subscripts(b, 1) - 1)::BIGINT AS seg_id FROM bodies)"""

ORACLES["corpus_files"] = f"""WITH {SEGMENTS},
{split_cte('segs', "conv_id || ':' || seg_id", 'conv_id, seg_id')}
SELECT split, conv_id, seg_id, body FROM splitted WHERE split IN ('train', 'val')"""

# ---------------------------------------------------------------- token streams and windows
WORD_STREAM = f"""WITH {WORD_VOCAB},{encoded('documents', 'doc_id', WORD_RE2)},
{split_cte('documents', 'doc_id', 'doc_id')},
dn AS (SELECT e.doc_id, s.split, md5('{C.DEFAULT_SEED}:' || e.doc_id) AS h, count(*) AS n
       FROM enc e JOIN splitted s USING (doc_id) GROUP BY e.doc_id, s.split),
doff AS (SELECT doc_id, split, sum(n) OVER (PARTITION BY split ORDER BY h, doc_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off
         FROM dn),
stream AS (SELECT d.split, (coalesce(d.off, 0) + e.pos)::BIGINT AS pos, e.id
           FROM enc e JOIN doff d USING (doc_id)),
sizes AS (SELECT split, count(*) AS n_tokens FROM stream GROUP BY split)"""

ORACLES["token_stream"] = WORD_STREAM + """
SELECT p.split, d.doc_id, coalesce(o.off, 0)::BIGINT AS "offset", count(e.pos)::BIGINT AS n_tokens,
       md5(coalesce(string_agg(e.id::VARCHAR, ',' ORDER BY e.pos), '')) AS ids_md5
FROM documents d JOIN splitted p USING (doc_id) LEFT JOIN doff o USING (doc_id) LEFT JOIN enc e USING (doc_id)
GROUP BY p.split, d.doc_id, o.off"""

ORACLES["stream_head"] = WORD_STREAM + """
SELECT s.split, s.n_tokens::BIGINT AS n_tokens,
       md5(string_agg(t.id::VARCHAR, ',' ORDER BY t.pos)) AS head_md5
FROM sizes s JOIN stream t ON t.split = s.split AND t.pos < 100
GROUP BY s.split, s.n_tokens"""

ORACLES["token_sink"] = WORD_STREAM + """
SELECT split, (pos // 4096 * 4096)::BIGINT AS start, count(*)::BIGINT AS n,
       md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS ids_md5
FROM stream GROUP BY split, pos // 4096"""

# every id with a successor is an input once, its successor a target once
ORACLES["packed_windows"] = WORD_STREAM + f""",
pairs AS (SELECT split, pos, id, lead(id) OVER (PARTITION BY split ORDER BY pos) AS nx FROM stream)
SELECT split, (pos // {C.CONTEXT_LENGTH})::BIGINT AS win_id, (pos // {C.CONTEXT_LENGTH} * {C.CONTEXT_LENGTH})::BIGINT AS start,
       count(*)::BIGINT AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS x_md5,
       md5(string_agg(nx::VARCHAR, ',' ORDER BY pos)) AS y_md5
FROM pairs WHERE nx IS NOT NULL GROUP BY split, pos // {C.CONTEXT_LENGTH}"""

STARTS = f""",
idx AS (SELECT range AS i FROM range({C.EVAL_ITERS * C.BATCH_SIZE})),
starts AS (SELECT s.split, i AS win_id, i // {C.BATCH_SIZE} AS batch,
                  ('0x' || substr(md5('{C.DEFAULT_SEED}:' || s.split || ':' || i), 1, 15))::BIGINT
                    % (s.n_tokens - {C.CONTEXT_LENGTH}) AS start
           FROM sizes s, idx),
pairs AS (SELECT split, pos, id, lead(id) OVER (PARTITION BY split ORDER BY pos) AS nx FROM stream),
wpos AS (SELECT split, win_id, batch, start, start + unnest(range({C.CONTEXT_LENGTH})) AS pos FROM starts)"""

ORACLES["random_windows"] = WORD_STREAM + STARTS + """
SELECT split, win_id::BIGINT AS win_id, batch::BIGINT AS batch, start::BIGINT AS start,
       md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS x_md5, md5(string_agg(nx::VARCHAR, ',' ORDER BY pos)) AS y_md5
FROM wpos JOIN pairs USING (split, pos) GROUP BY ALL"""

# ---------------------------------------------------------------- vector jobs
EPS = C.CLIP_EPS
CE_ROWS = f"""
WITH e AS (
  SELECT label,
         ln(list_sum(list_transform(embedding, lambda x: exp(greatest(least(x::DOUBLE, {1 - EPS}), {EPS})))))
           - greatest(least(embedding[label + 1]::DOUBLE, {1 - EPS}), {EPS}) AS ce_clip,
         ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))))
           + list_max(embedding)::DOUBLE - embedding[label + 1]::DOUBLE AS ce
  FROM embeddings)"""

ORACLES["cross_entropy"] = CE_ROWS + """
SELECT label::INTEGER AS label, count(*)::BIGINT AS n, round(avg(ce_clip), 9) AS ce_clip, round(avg(ce), 9) AS ce
FROM e GROUP BY label
UNION ALL
SELECT -1, count(*)::BIGINT, round(avg(ce_clip), 9), round(avg(ce), 9) FROM e"""

ORACLES["softmax_scores"] = """
WITH s AS (
  SELECT vec_id, embedding AS v, list_max(embedding)::DOUBLE AS m,
         list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))) AS z,
         list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))) AS zu
  FROM embeddings),
x AS (SELECT vec_id, m, z, zu, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM s)
SELECT vec_id, dim::INTEGER AS dim, round(exp(x::DOUBLE - m) / z, 9) AS prob,
       round(exp(x::DOUBLE) / zu, 9) AS prob_unshifted
FROM x"""

ORACLES["layer_norm"] = f"""
WITH s AS (
  SELECT vec_id, embedding AS v, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS mu
  FROM embeddings),
s2 AS (SELECT vec_id, v, mu,
              list_sum(list_transform(v, lambda x: (x::DOUBLE - mu) * (x::DOUBLE - mu))) / len(v) AS var
       FROM s),
x AS (SELECT vec_id, mu, var, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM s2)
SELECT vec_id, dim::INTEGER AS dim,
       round((x::DOUBLE - mu) / sqrt(var + {C.LAYER_NORM_EPS}) * (1.0 + (dim % 5)::DOUBLE / 10.0)
             + ((dim % 3) - 1)::DOUBLE / 10.0, 9) AS value
FROM x"""

ORACLES["one_hot_counts"] = """
SELECT (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS pred, label::INTEGER AS label, count(*)::BIGINT AS n
FROM embeddings GROUP BY ALL"""

ORACLES["residual_by_class"] = """
WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label::INTEGER AS label, dim::INTEGER AS dim,
       round(avg(x::DOUBLE - CASE WHEN dim = label THEN 1.0 ELSE 0.0 END), 9) AS mean_residual
FROM x GROUP BY label, dim"""

ORACLES["label_centroids"] = """
WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label::INTEGER AS label, dim::INTEGER AS dim, round(avg(x::DOUBLE), 9) AS mean
FROM x GROUP BY label, dim"""

ORACLES["linear_projection"] = """
WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
w AS (SELECT i, j, (((i * 7 + j * 13) % 17) - 8)::DOUBLE / 8.0 AS w
      FROM range(64) a(i), range(16) b(j))
SELECT vec_id, j::INTEGER AS j, round(sum(x::DOUBLE * w) + (j % 4)::DOUBLE / 4.0, 9) AS value
FROM x JOIN w USING (i) GROUP BY vec_id, j"""

ORACLES["centroid_scores"] = """
WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
w AS (SELECT i, label, avg(x::DOUBLE) AS w FROM x WHERE label IS NOT NULL GROUP BY i, label),
v AS (SELECT vec_id, i, x FROM x),
every AS (SELECT unnest(range((SELECT max(label) + 1 FROM w))) AS label),
s AS (SELECT vec_id, w.label, sum(x::DOUBLE * w) AS score FROM v JOIN w USING (i) GROUP BY vec_id, w.label)
SELECT e.vec_id, every.label::INTEGER AS label, round(coalesce(score, 0), 6) AS score
FROM (SELECT DISTINCT vec_id FROM x) e CROSS JOIN every LEFT JOIN s ON s.vec_id = e.vec_id AND s.label = every.label"""

ORACLES["embedding_lookup"] = """
WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) - 1 AS last_pos
           FROM events GROUP BY user_id),
j AS (SELECT l.user_id, l.event_id, list_transform(list_zip(a.embedding, b.embedding), lambda t: t[1] + t[2]) AS v,
             a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL AS found
      FROM l LEFT JOIN embeddings a ON a.vec_id = l.user_id LEFT JOIN embeddings b ON b.vec_id = l.last_pos),
x AS (SELECT user_id, event_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM j WHERE found)
SELECT user_id, event_id, dim::INTEGER AS dim, round(x::DOUBLE, 6) AS value FROM x
UNION ALL SELECT user_id, event_id, NULL, NULL FROM j WHERE NOT found"""

# ---------------------------------------------------------------- run metrics
RUN_ROWS = f"""
WITH r AS (
  SELECT user_id, event_id, ts, value,
         (row_number() OVER w - 1)::BIGINT AS iter,
         coalesce(min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {C.BEST_LOSS_INIT}) AS best_before,
         lag(ts) OVER w AS prev_ts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

ORACLES["running_best"] = RUN_ROWS + """
SELECT user_id, event_id, iter, value < best_before AS is_best,
       value < best_before AND iter > 0 AS save_checkpoint FROM r"""

ORACLES["step_duration"] = RUN_ROWS + """
SELECT user_id, event_id, round(date_diff('microsecond', prev_ts, ts) / 1000.0, 3) AS dt_ms FROM r"""

ORACLES["mean_loss"] = """
SELECT user_id, event_type, round(avg(value), 9) AS mean_loss, count(*)::BIGINT AS n
FROM events GROUP BY user_id, event_type"""

ORACLES["every_n"] = RUN_ROWS + """
SELECT user_id, iter, event_id, value FROM r WHERE iter % 10 = 0"""

# ---------------------------------------------------------------- sampling
U52 = "((('0x' || substr(md5({k}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"

ORACLES["weighted_sample"] = f"""
SELECT o_orderkey, o_orderstatus, 1.0 / (1.0 - 0.1) AS weight FROM orders
WHERE {U52.format(k="'42:' || o_orderkey")} >= 0.1"""

ORACLES["sample_estimate"] = f"""
WITH s AS (SELECT * FROM orders WHERE {U52.format(k="'42:' || o_orderkey")} >= 0.1),
e AS (SELECT o_orderstatus, count(*) AS n_kept, sum((1.0 / (1.0 - 0.1)) * o_totalprice) AS est
      FROM s GROUP BY o_orderstatus),
t AS (SELECT o_orderstatus, count(*) AS n_all, sum(o_totalprice) AS total FROM orders GROUP BY o_orderstatus)
SELECT o_orderstatus, n_kept::BIGINT AS n_kept, n_all::BIGINT AS n_all, round(est, 2) AS est_total,
       round(total, 2) AS true_total
FROM e JOIN t USING (o_orderstatus)"""

ORACLES["weighted_draw"] = f"""
SELECT o_custkey, arg_min(o_orderkey, -ln({U52.format(k="'42:' || o_custkey || ':' || o_orderkey")}) / o_totalprice::DOUBLE) AS o_orderkey
FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey"""

# ---------------------------------------------------------------- bigram language model
LM_BASE = f"""WITH {WORD_VOCAB},{encoded('documents', 'doc_id', WORD_RE2)},
{split_cte('documents', 'doc_id', 'doc_id')},
big AS (SELECT a.doc_id, s.split, a.id AS w, b.id AS nx
        FROM enc a JOIN enc b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
        JOIN splitted s ON s.doc_id = a.doc_id),
cnt AS (SELECT w, nx, count(*) AS c FROM big WHERE split = 'train' GROUP BY w, nx),
ctx AS (SELECT w, sum(c) AS ctx, count(*) AS n_next FROM cnt GROUP BY w),
vs AS (SELECT count(*) AS V FROM vocab)"""

ORACLES["bigram_model"] = LM_BASE + """
SELECT w, nx, c::BIGINT AS count, round((c + 1.0) / (ctx + (SELECT V FROM vs)), 12) AS prob
FROM cnt JOIN ctx USING (w)"""

ORACLES["bigram_cross_entropy"] = LM_BASE + """
SELECT s.doc_id, s.split, count(b.w)::BIGINT AS n_bigrams,
       round(avg(CASE WHEN b.w IS NOT NULL THEN -ln((coalesce(c.c, 0) + 1.0) / (coalesce(x.ctx, 0) + (SELECT V FROM vs))) END), 9) AS cross_entropy
FROM splitted s LEFT JOIN big b ON b.doc_id = s.doc_id LEFT JOIN cnt c ON c.w = b.w AND c.nx = b.nx LEFT JOIN ctx x ON x.w = b.w
GROUP BY s.doc_id, s.split"""

ORACLES["eval_batches"] = WORD_STREAM + STARTS + f""",
big AS (SELECT a.doc_id, s.split, a.id AS w, b.id AS nx
        FROM enc a JOIN enc b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN splitted s ON s.doc_id = a.doc_id),
cnt AS (SELECT w, nx, count(*) AS c FROM big WHERE split = 'train' GROUP BY w, nx),
ctx AS (SELECT w, sum(c) AS ctx FROM cnt GROUP BY w),
vs AS (SELECT count(*) AS V FROM vocab),
wp AS (SELECT split, batch, id AS w, nx FROM wpos JOIN pairs USING (split, pos)),
per AS (SELECT p.split, p.batch, count(*) AS n,
               avg(-ln((coalesce(c.c, 0) + 1.0) / (coalesce(x.ctx, 0) + (SELECT V FROM vs)))) AS loss
        FROM wp p LEFT JOIN cnt c USING (w, nx) LEFT JOIN ctx x USING (w) GROUP BY p.split, p.batch)
SELECT split, count(*)::BIGINT AS n_batches, sum(n)::BIGINT AS n_targets, round(avg(loss), 9) AS mean_loss FROM per GROUP BY split"""

# a prompt without tokens ends with padding; a context never seen draws from all contexts (-1)
ORACLES["next_token_draw"] = LM_BASE.replace(
    encoded('documents', 'doc_id', WORD_RE2),
    encoded('documents', 'doc_id', WORD_RE2) + ",\n" + encoded('conversations', 'conv_id, turn', WORD_RE2)
    .replace("pieces AS", "cpieces AS").replace("toks AS", "ctoks AS").replace("enc AS", "cenc AS")
    .replace("FROM pieces", "FROM cpieces").replace("FROM toks", "FROM ctoks")) + f""",
allc AS (SELECT w, nx, c FROM cnt UNION ALL SELECT -1, nx, sum(c) FROM cnt GROUP BY nx),
actx AS (SELECT w, sum(c) AS ctx FROM allc GROUP BY w),
iv AS (SELECT w, nx, coalesce(sum(c) OVER (PARTITION BY w ORDER BY nx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
              c FROM allc),
last AS (SELECT c.conv_id, c.turn, coalesce(arg_max(e.id, e.pos), {C.PAD_ID}) AS last_id
         FROM conversations c LEFT JOIN cenc e USING (conv_id, turn) GROUP BY c.conv_id, c.turn),
ctxt AS (SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM ctx x WHERE x.w = l.last_id) THEN l.last_id ELSE -1 END AS w FROM last l),
pr AS (SELECT l.conv_id, l.turn, l.last_id, l.w, ('0x' || substr(md5('42:' || l.conv_id || ':' || l.turn), 1, 15))::BIGINT % x.ctx AS r
       FROM ctxt l JOIN actx x ON x.w = l.w)
SELECT p.conv_id, p.turn, p.last_id::INTEGER AS last_id, i.nx::INTEGER AS next_id
FROM pr p JOIN iv i ON i.w = p.w AND p.r >= i.lo AND p.r < i.lo + i.c"""

SPAN_RE2 = "[" + UNI_WS + "]*(?:" + WORD_RE2 + ")"
ORACLES["token_spans"] = f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, {lit(SPAN_RE2)}) AS ps FROM documents),
x AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS pos FROM p),
e AS (SELECT doc_id, pos, piece, regexp_replace(piece, {lit('^[' + UNI_WS + ']+')}, '') AS token,
             sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS "end" FROM x)
SELECT doc_id, count(e.pos)::BIGINT AS n_tokens, coalesce(max(e."end"), 0)::BIGINT AS last_end,
       md5(coalesce(string_agg((e."end" - length(e.token)) || '-' || e."end", ',' ORDER BY e.pos), '')) AS spans_md5
FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id"""

ORACLES["nfc_text"] = """
SELECT doc_id, length(nfc_normalize(text))::BIGINT AS n_chars, md5(nfc_normalize(text)) AS text_md5
FROM documents"""

ORACLES["vector_stats"] = """
WITH s AS (SELECT vec_id, embedding AS v,
                  list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS mu
           FROM embeddings)
SELECT vec_id, round(mu, 9) AS mean,
       round(list_sum(list_transform(v, lambda x: (x::DOUBLE - mu) * (x::DOUBLE - mu))) / len(v), 9) AS var
FROM s"""
