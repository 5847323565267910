"""SQL twins of the queries, for an independent engine on the same tables.

The SQL states each result in the plainest way, with windows over whole
tables and one row per token; it shares parameters and fixed values with the
queries, but none of their plans.
"""

from __future__ import annotations

from quern.functions.text import TONE_PAIRS, WHITE_SPACE
from quern.plans.queries import (
    ACCUMULATE,
    BATCH,
    BLOCK,
    BYTE_VOCAB,
    DECOMPOSED,
    MIN_FREQ,
    PADDING,
    PIECE_VOCAB,
    PUBLISHED_MANY,
    PUBLISHED_RANKS,
    RANKS,
    RESUMED,
    SEED,
    SEQ,
    SHARD,
    TRAIN_STEPS,
    VOCAB_SIZE,
    WORLD,
    published_path,
)

SPACES = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_CHARS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
WORDS = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACES}]+"
WORDS_OR_NEWLINE = r"\n|" + WORDS
SEPARATOR = "\x01"


def _charset(text: str, punct: bool = True) -> str:
    kept = r"\p{P}" if punct else ""
    return rf"regexp_replace({text}, '[^\p{{Latin}}{kept}0-9{SPACES}]+', '', 'g')"


def _tone(text: str) -> str:
    for old, new in TONE_PAIRS.items():
        text = f"replace({text}, '{old}', '{new}')"
    return text


def _chars(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


def _decomposed(text: str) -> str:
    for whole, apart in DECOMPOSED.items():
        text = f"replace({text}, '{whole}', {_chars(apart)})"
    return text


def _strip(text: str) -> str:
    return f"trim({text}, {_chars(WHITE_SPACE)})"


def _clean(text: str) -> str:
    return _strip(_tone(_charset(f"nfc_normalize({text})")))


CLEAN = f"clean AS (SELECT doc_id, {_clean('text')} AS text FROM documents)"
LISTED = f"listed AS (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS ws FROM clean)"
WORD_ROWS = """word_rows AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM listed)"""
COUNTS = "counts AS (SELECT word, count(*) AS n FROM word_rows GROUP BY word)"
VOCAB = f"""frequent AS (
  SELECT word, n FROM counts WHERE n >= {MIN_FREQ} ORDER BY n DESC, word LIMIT {VOCAB_SIZE - 3}),
vocab AS (
  SELECT 0 AS id, '<unk>' AS token, true AS is_special
  UNION ALL SELECT 1, '<|endoftext|>', true
  UNION ALL SELECT CAST(1 + row_number() OVER (ORDER BY n DESC, word) AS INTEGER), word, false FROM frequent
  UNION ALL SELECT CAST((SELECT count(*) FROM frequent) + 2 AS INTEGER), chr(10), true)"""
TOKENS = """tokens AS (
  SELECT doc_id, pos, coalesce(v.id, 0) AS id
  FROM word_rows LEFT JOIN (SELECT * FROM vocab WHERE NOT is_special) v ON word = token
  UNION ALL SELECT doc_id, 1000000000, 1 FROM clean)"""
TEXT = f"{CLEAN}, {LISTED}, {WORD_ROWS}"
ENCODED = f"{TEXT}, {COUNTS}, {VOCAB}, {TOKENS}"
PLACED = f"""{ENCODED},
stream AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM tokens),
kept AS (
  SELECT id, g // {SHARD} AS shard_id, g % {SHARD} AS p FROM stream
  QUALIFY count(*) OVER (PARTITION BY g // {SHARD}) > 1)"""
USABLE = f"""{PLACED},
labelled AS (
  SELECT shard_id, p, id AS input_id, lead(id) OVER (PARTITION BY shard_id ORDER BY p) AS label FROM kept),
usable AS (
  SELECT row_number() OVER (ORDER BY shard_id, p) - 1 AS u, input_id, label FROM labelled WHERE label IS NOT NULL)"""
HASH = f"CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 15) AS BIGINT)"
IDS = "string_agg(CAST({0} AS VARCHAR), ' ' ORDER BY {1})"

RUN_LOG = f"""run_log AS (
  SELECT CAST(user_id % {RANKS} AS INTEGER) AS rank,
    row_number() OVER (PARTITION BY user_id % {RANKS} ORDER BY ts, event_id) - 1 AS batch_idx,
    value / 100 AS loss, CAST(0.1 AS DOUBLE) + (event_id % 10) / CAST(100 AS DOUBLE) AS fb_time
  FROM events)"""
STEPS = f"""{RUN_LOG}, steps AS (
  SELECT rank, batch_idx // {ACCUMULATE} AS step, sum(loss / {ACCUMULATE}) AS batch_loss,
    sum(fb_time) AS fb_time, count(*) AS n
  FROM run_log GROUP BY ALL HAVING count(*) = {ACCUMULATE})"""
GLOBAL_STEPS = f"{STEPS}, g AS (SELECT step, avg(batch_loss) AS batch_loss FROM steps GROUP BY step)"
METERS = f"""{RUN_LOG}, meters AS (
  SELECT rank, 'loss' AS name, sum(loss) AS sum, count(*) AS count FROM run_log GROUP BY rank)"""
SCORES = """scores AS (
  SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label,
    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS token_id, CAST(unnest(embedding) AS DOUBLE) AS logit
  FROM embeddings)"""


def _softmax(source: str, t: float = 1.0) -> str:
    return f"""(SELECT row_id, token_id, logit, m / sum(m) OVER (PARTITION BY row_id) AS prob FROM (
      SELECT row_id, token_id, logit / {t} AS logit,
        exp(logit / {t} - max(logit / {t}) OVER (PARTITION BY row_id)) AS m FROM {source}))"""


def _nucleus(probs: str, p: float) -> str:
    return f"""(SELECT row_id, token_id, logit FROM (
      SELECT *, sum(prob) OVER (PARTITION BY row_id ORDER BY logit DESC, token_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {probs})
      WHERE before IS NULL OR before < {p})"""


def _cosine(factor: str) -> str:
    s = "greatest(step, 1)"
    return f"""{factor} * CASE WHEN {s} <= 100 THEN CAST(0.6 AS DOUBLE) * {s} / 100
      WHEN {s} > 900 THEN CAST(0.06 AS DOUBLE)
      ELSE CAST(0.06 AS DOUBLE) + (CAST(0.6 AS DOUBLE) - CAST(0.06 AS DOUBLE)) * 0.5
        * (1 + cos(pi() * ({s} - 100) / CAST(800 AS DOUBLE))) END"""


def _merged(base: str, n_merges: str, prefix: str) -> str:
    """Merge the most frequent pair, again and again; ``base`` gives ``symbols, n``."""
    glue = f"CASE WHEN starts_with(r, '{prefix}') THEN substr(r, {len(prefix) + 1}) ELSE r END" if prefix else "r"
    return f"""base AS ({base}),
trained AS (
  SELECT 0 AS it, symbols, n, '' AS l, '' AS r FROM base
  UNION ALL
  SELECT it + 1, replace(symbols, ' ' || b.l || '  ' || b.r || ' ', ' ' || b.m || ' '), n, b.l, b.r
  FROM trained, (
    SELECT l, r, l || {glue} AS m FROM (
      SELECT unnest(parts[1:-2]) AS l, unnest(parts[2:]) AS r, n
      FROM (SELECT string_split(trim(symbols), '  ') AS parts, n FROM trained) WHERE len(parts) > 1)
    GROUP BY l, r HAVING sum(n) >= {MIN_FREQ} ORDER BY sum(n) DESC, l, r LIMIT 1) b
  WHERE it < ({n_merges})),
merges AS (SELECT DISTINCT it, l, r, l || {glue} AS token FROM trained WHERE it > 0)"""


CORPUS_WORDS = f"""corpus_counts AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all({_clean('text')}, '{WORDS}')) AS word FROM documents) GROUP BY word)"""
LETTERS = """letters AS (
  SELECT DISTINCT token, is_continuation FROM (
    SELECT c AS token, false AS is_continuation FROM chars
    UNION ALL SELECT '##' || c, true FROM chars WHERE i > 1))"""
PIECE_TRAINING = f"""{CORPUS_WORDS},
chars AS (
  SELECT unnest(cs) AS c, generate_subscripts(cs, 1) AS i
  FROM (SELECT regexp_extract_all(word, '(?s).') AS cs FROM corpus_counts)),
{LETTERS},
""" + _merged(
    r"""SELECT ' ' || regexp_extract(word, '(?s)^.')
      || regexp_replace(regexp_replace(word, '(?s)^.', ''), '(?s)(.)', '  ##\1', 'g') || ' ' AS symbols, n
    FROM corpus_counts""",
    # some more, as a merge may give a token that is there already
    f"{PIECE_VOCAB} + 20 - (SELECT count(*) FROM letters)",
    "##",
) + """,
tokens_in_order AS (
  SELECT 0 AS part, 0 AS k, '<unk>' AS token, true AS is_special, false AS is_continuation
  UNION ALL SELECT 0, 1, '<|endoftext|>', true, false
  UNION ALL SELECT CASE WHEN is_continuation THEN 2 ELSE 1 END, row_number() OVER (ORDER BY token), token, false,
    is_continuation FROM letters
  UNION ALL SELECT 3, it, token, false, starts_with(l, '##') FROM (
    SELECT token, min(it) AS it, arg_min(l, it) AS l FROM merges WHERE token NOT IN (SELECT token FROM letters)
    GROUP BY token ORDER BY 2 LIMIT (""" + str(PIECE_VOCAB - 3) + """ - (SELECT count(*) FROM letters)))
  UNION ALL SELECT 4, 0, chr(10), true, false),
pieces AS (
  SELECT CAST(row_number() OVER (ORDER BY part, k) - 1 AS INTEGER) AS id, token, is_special, is_continuation
  FROM tokens_in_order)"""

BYTE_SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}\x{{01}}]+|[{SPACES}]+".replace("'", "''")


def _byte_pieces(table: str, key: str) -> str:
    # No look-ahead here: a mark goes before the last space of a run that text follows.
    marked = rf"regexp_replace(text, '([{SPACES}]+)([{SPACES}][^{SPACES}])', '\1' || chr(1) || '\2', 'g')"
    return f"SELECT {key}, regexp_extract_all({marked}, '{BYTE_SPLIT}') AS ws FROM {table}"


HEX_SYMBOLS = r"regexp_replace(lower(hex(encode(word))), '(..)', ' \1 ', 'g')"
BYTE_TRAINING = _merged(
    f"""SELECT {HEX_SYMBOLS} AS symbols, count(*) AS n FROM (
      SELECT unnest(ws) AS word FROM ({_byte_pieces('documents', 'doc_id')})) GROUP BY word""",
    f"{BYTE_VOCAB} - 1 - 256",
    "",
) + """,
byte_tokens AS (
  SELECT CAST(range AS INTEGER) AS id, lower(printf('%02x', range)) AS token, false AS is_special FROM range(256)
  UNION ALL SELECT CAST(255 + it AS INTEGER), token, false FROM merges
  UNION ALL SELECT CAST(256 + (SELECT count(*) FROM merges) AS INTEGER), '<|endoftext|>', true)"""


def _published(path: str, end_id: int) -> str:
    """Ids of all documents: in each distinct piece the union of the lowest rank is made, a union a step."""
    return f"""WITH RECURSIVE ranks AS (
  SELECT lower(hex(from_base64(b64))) AS token, id
  FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'b64': 'VARCHAR', 'id': 'INTEGER'}})),
lists AS ({_byte_pieces('documents', 'doc_id')}),
occurrences AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists),
steps AS (
  SELECT DISTINCT word, 0 AS it, string_split(trim({HEX_SYMBOLS}), '  ') AS parts FROM occurrences
  UNION ALL
  SELECT word, it + 1, parts[:i - 1] || [parts[i] || parts[i + 1]] || parts[i + 2:] FROM (
    SELECT word, it, any_value(parts) AS parts, arg_min(i, CAST(ranks.id AS BIGINT) * 100000000 + i) AS i FROM (
      SELECT word, it, parts, unnest(range(1, len(parts))) AS i FROM steps WHERE len(parts) > 1)
    JOIN ranks ON ranks.token = parts[i] || parts[i + 1] GROUP BY word, it)),
ends AS (SELECT word, arg_max(parts, it) AS parts FROM steps GROUP BY word),
found AS (
  SELECT word, list(id ORDER BY j) AS ids FROM (
    SELECT word, unnest(parts) AS token, generate_subscripts(parts, 1) AS j FROM ends)
  JOIN ranks USING (token) GROUP BY word),
flat AS (
  SELECT doc_id, pos, unnest(ids) AS id, generate_subscripts(ids, 1) AS j FROM occurrences JOIN found USING (word)
  UNION ALL SELECT doc_id, 1000000000, {end_id}, 1 FROM documents)
SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, j) AS tokens, CAST(count(*) AS INTEGER) AS n_tokens
FROM flat GROUP BY doc_id"""


def _piece_encoding(source: str, key: str, list_pattern: str) -> str:
    """Longest match first over the distinct words of ``source``, as ``ids`` per word."""
    return f"""word_lists AS (SELECT {key}, regexp_extract_all(text, '{list_pattern}') AS ws FROM {source}),
occurrences AS (SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM word_lists),
walk AS (
  SELECT DISTINCT word, 1 AS place, CAST([] AS INTEGER[]) AS ids, length(word) > 100 AS failed FROM occurrences
  WHERE word <> chr(10)
  UNION ALL
  SELECT word, place + coalesce(size, 0), list_append(ids, id), size IS NULL FROM (
    SELECT w.word, w.place, w.ids, max(length(p.token) - CASE WHEN w.place > 1 THEN 2 ELSE 0 END) AS size,
      arg_max(p.id, length(p.token)) AS id
    FROM walk w LEFT JOIN plain p
      ON p.is_continuation = (w.place > 1)
      AND CASE WHEN w.place > 1 THEN '##' ELSE '' END || substr(w.word, w.place, p.size) = p.token
    WHERE NOT w.failed AND w.place <= length(w.word)
    GROUP BY w.word, w.place, w.ids)),
found AS (
  SELECT word, CASE WHEN failed THEN [0] ELSE ids END AS ids FROM walk WHERE failed OR place > length(word)
  UNION ALL SELECT chr(10), [(SELECT max(id) FROM pieces)])"""


# A token is looked up by its text, so one that begins with the mark can also begin a word.
PLAIN = """plain AS (
  SELECT id, token, false AS is_continuation, length(token) AS size FROM pieces WHERE NOT is_special
  UNION ALL SELECT id, token, true, length(token) - 2 FROM pieces
  WHERE NOT is_special AND starts_with(token, '##') AND length(token) > 2)"""


def all_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["read_documents"] = "SELECT doc_id, text FROM documents"
    q["read_lines"] = """SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"""
    q["union_sources"] = """SELECT 'documents' AS origin, text FROM documents
      UNION ALL SELECT 'conversations', text FROM conversations"""
    q["limit_docs"] = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 300"
    ranked = f"SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id) AS rn, count(*) OVER () AS n FROM documents"
    frac = f"SELECT doc_id, CASE WHEN rn <= ceil(0.1 * n) THEN 'validation' ELSE 'train' END AS split FROM ({ranked})"
    q["split_fraction"] = frac
    q["split_count"] = (
        f"SELECT doc_id, CASE WHEN rn <= 37 THEN 'validation' ELSE 'train' END AS split FROM ({ranked})"
    )
    q["split_counts"] = f"SELECT split, count(*) AS n_docs FROM ({frac}) GROUP BY split"
    q["text_sink"] = f"""SELECT split, unnest(string_split(text, chr(10))) AS line
      FROM documents JOIN ({frac}) USING (doc_id)"""
    q["rename_split"] = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'validation' ELSE 'train' END AS split
      FROM documents"""
    q["text_order"] = f"""SELECT split, line, row_number() OVER (PARTITION BY split ORDER BY doc_id, line_no) - 1 AS place
      FROM (SELECT doc_id, split, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
        FROM (SELECT doc_id, split, string_split(text, chr(10)) AS ls FROM documents JOIN ({frac}) USING (doc_id)))"""
    q["shuffle_docs"] = f"SELECT doc_id, rn - 1 AS pos FROM ({ranked})"
    q["chunk_ids"] = "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS chunk_id FROM documents"
    q["contiguous_pieces"] = "SELECT doc_id, ntile(48) OVER (ORDER BY doc_id) - 1 AS piece_id FROM documents"

    for name, expr in {
        "nfc_text": f"nfc_normalize({_decomposed('text')})",
        "clean_charset": _charset("text"),
        "clean_nopunct": _charset("text", punct=False),
        "normalize_tone": _tone("text"),
        "strip_text": _strip(f"{_chars(PADDING)} || text || {_chars(PADDING[::-1])}"),
        "clean_text": _clean("text"),
        "clean_sql": _clean("text"),
    }.items():
        q[name] = f"SELECT doc_id, {expr} AS text FROM documents"
    q["pretokenize"] = f"WITH {TEXT} SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM word_rows"

    q["word_counts"] = f"WITH {TEXT}, {COUNTS} SELECT word, n FROM counts WHERE n >= 3"
    q["word_counts_lower"] = f"WITH {TEXT} SELECT lower(word) AS word, count(*) AS n FROM word_rows GROUP BY 1"
    q["alphabet"] = f"""WITH {TEXT}, {COUNTS}, chars AS (
        SELECT unnest(cs) AS c, generate_subscripts(cs, 1) AS i
        FROM (SELECT regexp_extract_all(word, '(?s).') AS cs FROM counts)), {LETTERS}
      SELECT token, is_continuation FROM letters"""
    q["pair_counts"] = f"""WITH {TEXT}, {COUNTS},
      spelled AS (SELECT regexp_extract_all(word, '(?s).') AS cs, n FROM counts),
      pairs AS (SELECT unnest(cs[1:-2]) AS a, unnest(cs[2:]) AS b, generate_subscripts(cs[2:], 1) AS i, n
        FROM spelled WHERE len(cs) > 1)
      SELECT CASE WHEN i > 1 THEN '##' || a ELSE a END AS l, '##' || b AS r, CAST(sum(n) AS BIGINT) AS n
      FROM pairs GROUP BY 1, 2"""
    q["vocab_table"] = f"""WITH {TEXT}, {COUNTS}, {VOCAB}
      SELECT id, token, is_special, false AS is_continuation FROM vocab"""
    q["vocab_sink"] = q["vocab_table"]
    q["vocab_stats"] = f"""WITH {TEXT}, {COUNTS}, {VOCAB}
      SELECT count(*) AS vocab_size, max(id) AS max_id, CAST(sum(CAST(is_special AS INTEGER)) AS BIGINT) AS n_special,
        CAST(0 AS BIGINT) AS n_continuation FROM vocab"""
    q["train_vocab"] = f"""WITH RECURSIVE {PIECE_TRAINING} SELECT id, token, is_special, is_continuation FROM pieces"""
    q["train_byte_vocab"] = f"""WITH RECURSIVE {BYTE_TRAINING}
      SELECT id, token, is_special, false AS is_continuation FROM byte_tokens"""
    q["word_level_encode"] = f"""WITH {ENCODED}
      SELECT doc_id, {IDS.format('id', 'pos')} AS tokens, CAST(count(*) AS INTEGER) AS n_tokens
      FROM tokens GROUP BY doc_id"""
    q["word_lookup"] = q["word_level_encode"]
    q["append_eot"] = f"""WITH {ENCODED}
      SELECT doc_id, CAST(arg_max(id, pos) AS INTEGER) AS last_id, CAST(count(*) AS INTEGER) AS n_tokens
      FROM tokens GROUP BY doc_id"""
    q["encode_wordpiece"] = f"""WITH RECURSIVE {PIECE_TRAINING}, {PLAIN}, {CLEAN},
      {_piece_encoding('clean', 'doc_id', WORDS_OR_NEWLINE)},
      flat AS (
        SELECT doc_id, pos, unnest(ids) AS id, generate_subscripts(ids, 1) AS j
        FROM occurrences JOIN found USING (word)
        UNION ALL SELECT doc_id, 1000000000, 1, 1 FROM clean)
      SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, j) AS tokens,
        CAST(count(*) AS INTEGER) AS n_tokens FROM flat GROUP BY doc_id"""
    bytes_encoded = f"""WITH RECURSIVE {BYTE_TRAINING},
      lists AS ({_byte_pieces('documents', 'doc_id')}),
      occurrences AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists),
      words AS (SELECT DISTINCT word FROM occurrences),
      spelled AS (
        SELECT word, string_split(trim(list_reduce(
          list_prepend({HEX_SYMBOLS}, (
            SELECT list(' ' || l || '  ' || r || ' ' ORDER BY it) FROM merges)),
          lambda acc, m: replace(acc, m, ' ' || replace(trim(m), '  ', '') || ' '))), '  ') AS parts FROM words),
      found AS (
        SELECT word, list(id ORDER BY j) AS ids FROM (
          SELECT word, unnest(parts) AS token, generate_subscripts(parts, 1) AS j FROM spelled)
        JOIN byte_tokens USING (token) GROUP BY word),
      flat AS (
        SELECT doc_id, pos, unnest(ids) AS id, generate_subscripts(ids, 1) AS j
        FROM occurrences JOIN found USING (word)
        UNION ALL SELECT doc_id, 1000000000, (SELECT max(id) FROM byte_tokens), 1 FROM documents)"""
    q["encode_bpe"] = f"""{bytes_encoded}
      SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, j) AS tokens,
        CAST(count(*) AS INTEGER) AS n_tokens FROM flat GROUP BY doc_id"""
    # the file of ranks holds the vocabulary that the query reads, with its merges, from the other file
    if (path := published_path(PUBLISHED_RANKS)) is not None:
        q["encode_published"] = _published(path, 50256)
        q["encode_ranks"] = _published(published_path(PUBLISHED_MANY), 50256)
    q["keep_text"] = f"SELECT doc_id, clean.text, n_tokens FROM ({q['encode_wordpiece']}) JOIN (WITH {CLEAN} SELECT * FROM clean) clean USING (doc_id)"
    q["decode_ids"] = f"""WITH {ENCODED}
      SELECT doc_id, replace(coalesce(string_agg(token, ' ' ORDER BY pos), ''), ' ##', '') AS text
      FROM tokens LEFT JOIN (SELECT * FROM vocab WHERE NOT is_special) v USING (id) GROUP BY doc_id"""
    q["decode_bytes"] = "SELECT doc_id, text FROM documents"
    q["token_range_report"] = f"""WITH {ENCODED}
      SELECT CAST(min(id) AS INTEGER) AS min_id, CAST(max(id) AS INTEGER) AS max_id, count(*) AS n_ids,
        min(id) >= 0 AND max(id) <= 65535 AS fits FROM tokens"""
    q["token_totals"] = f"""WITH {ENCODED}
      SELECT split, count(*) AS total_tokens, count(DISTINCT doc_id) AS n_records
      FROM tokens JOIN ({frac}) USING (doc_id) GROUP BY split"""

    q["token_offsets"] = f"""WITH {ENCODED}, sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id)
      SELECT doc_id, CAST(n AS INTEGER) AS n_tokens,
        CAST(sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS token_offset FROM sizes"""
    q["pack_shards"] = f"""WITH {PLACED}
      SELECT shard_id, p // {BLOCK} AS block_id, min(p) AS pos, CAST(count(*) AS INTEGER) AS n_tokens,
        {IDS.format('id', 'p')} AS ids FROM kept GROUP BY 1, 2"""
    q["shard_sink"] = q["array_shard_sink"] = q["pack_shards"]
    q["shard_stats"] = f"""WITH {PLACED}
      SELECT shard_id, count(*) AS n_tokens, count(DISTINCT p // {BLOCK}) AS n_blocks FROM kept GROUP BY shard_id"""
    q["expected_shards"] = f"""WITH {ENCODED}
      SELECT count(*) AS total_tokens, count(*) // {SHARD} AS full_shards FROM tokens"""
    q["flat_stream"] = f"""WITH {ENCODED}, placed AS (
        SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY doc_id, pos) - 1 AS g
        FROM tokens JOIN ({frac}) USING (doc_id))
      SELECT split, g // {BLOCK} AS block_id, min(g) AS pos, CAST(count(*) AS INTEGER) AS n_tokens,
        {IDS.format('id', 'g')} AS ids FROM placed GROUP BY 1, 2"""
    q["flat_sink"] = q["flat_file_sink"] = q["flat_stream"]
    q["line_stream"] = f"""WITH RECURSIVE {PIECE_TRAINING}, {PLAIN},
      lines AS (
        SELECT doc_id * 1000000 + line_no AS k, {_clean('line')} AS text
        FROM ({q['read_lines']})),
      {_piece_encoding('lines', 'k', WORDS_OR_NEWLINE)},
      flat AS (
        SELECT k, pos, unnest(ids) AS id, generate_subscripts(ids, 1) AS j FROM occurrences JOIN found USING (word)
        UNION ALL SELECT k, 1000000000, 1, 1 FROM lines),
      placed AS (
        SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY k, pos, j) - 1 AS g
        FROM flat JOIN ({frac}) ON doc_id = k // 1000000)
      SELECT split, g // {BLOCK} AS block_id, CAST(count(*) AS INTEGER) AS n_tokens, {IDS.format('id', 'g')} AS ids
      FROM placed GROUP BY 1, 2"""
    q["web_shards"] = f"""{bytes_encoded},
      placed AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos, j) - 1 AS g FROM flat)
      SELECT g // 100000 AS shard_id, g % 100000 // {BLOCK} AS block_id, CAST(count(*) AS INTEGER) AS n_tokens,
        {IDS.format('id', 'g')} AS ids
      FROM (SELECT * FROM placed QUALIFY count(*) OVER (PARTITION BY g // 100000) > 1) GROUP BY 1, 2"""
    q["input_label_pairs"] = f"""WITH {USABLE}
      SELECT u, CAST(input_id AS INTEGER) AS input_id, CAST(label AS INTEGER) AS label FROM usable"""
    both = f"{IDS.format('input_id', 'u')} AS input_ids, {IDS.format('label', 'u')} AS labels"
    q["lm_sequences"] = f"""WITH {USABLE}
      SELECT u // {SEQ} AS seq_id, {both} FROM usable GROUP BY 1 HAVING count(*) = {SEQ}"""
    batches = f"""{USABLE}, batched AS (
        SELECT u, input_id, label, u // {SEQ} AS seq_id, u // {SEQ * BATCH} AS batch_id FROM usable
        QUALIFY count(*) OVER (PARTITION BY u // {SEQ * BATCH}) = {SEQ * BATCH})"""
    row = f"CAST(seq_id % {BATCH} AS INTEGER) AS row_in_batch"
    rank = f"CAST(batch_id % {WORLD} AS INTEGER) AS rank, batch_id // {WORLD} AS step"
    q["lm_batches"] = f"""WITH {batches} SELECT batch_id, {row}, 'array<bigint>' AS id_type, {both}
      FROM batched GROUP BY batch_id, seq_id"""
    q["rank_batches"] = f"WITH {batches} SELECT {rank}, {row}, seq_id, {both} FROM batched GROUP BY batch_id, seq_id"
    q["rank_sink"] = q["rank_batches"]
    q["eval_batches"] = f"""WITH {batches}
      SELECT {rank}, {row}, {both} FROM batched WHERE batch_id // {WORLD} < 20 GROUP BY batch_id, seq_id"""
    plan = f"""{batches}, plan AS (
        SELECT batch_id, CAST(batch_id % {WORLD} AS INTEGER) AS rank, batch_id // {WORLD} AS step,
          CASE WHEN count(*) OVER (PARTITION BY batch_id % {WORLD}, batch_id // {WORLD} // {ACCUMULATE}) = {ACCUMULATE}
            THEN batch_id // {WORLD} // {ACCUMULATE} END AS opt_step
        FROM (SELECT DISTINCT batch_id FROM batched))"""
    q["batch_plan"] = f"""WITH {plan}
      SELECT batch_id, rank, step, coalesce(opt_step, -1) AS opt_step, {BATCH} AS batch_size,
        {BATCH * WORLD * ACCUMULATE} AS effective_batch_size,
        CAST({BATCH * ACCUMULATE * SEQ} AS BIGINT) AS tokens_per_step FROM plan"""
    q["epoch_plan"] = f"""WITH {plan},
      opt AS (SELECT rank, opt_step, count(*) AS micro_batches FROM plan WHERE opt_step IS NOT NULL GROUP BY 1, 2),
      sized AS (SELECT *, count(*) OVER (PARTITION BY rank) AS per_epoch FROM opt),
      replayed AS (
        SELECT rank, unnest(range(0, CAST(ceil({TRAIN_STEPS} / per_epoch) AS BIGINT))) AS epoch, opt_step, per_epoch,
          micro_batches FROM sized)
      SELECT rank, CAST(epoch AS INTEGER) AS epoch, opt_step, epoch * per_epoch + opt_step AS global_step, micro_batches
      FROM replayed WHERE epoch * per_epoch + opt_step < {TRAIN_STEPS}"""

    q["replay_batches"] = f"""WITH {plan},
      stored AS (
        SELECT batch_id, seq_id, {row}, {both} FROM batched GROUP BY batch_id, seq_id),
      sized AS (SELECT *, count(DISTINCT opt_step) OVER (PARTITION BY rank) AS per_epoch FROM plan WHERE opt_step IS NOT NULL),
      replayed AS (
        SELECT *, unnest(range(0, CAST(ceil({TRAIN_STEPS} / per_epoch) AS BIGINT))) AS epoch FROM sized)
      SELECT rank, epoch, epoch * per_epoch + opt_step AS global_step, CAST(step % {ACCUMULATE} AS INTEGER) AS micro,
        row_in_batch, seq_id, input_ids, labels
      FROM replayed JOIN stored USING (batch_id)
      WHERE epoch * per_epoch + opt_step >= {RESUMED} AND epoch * per_epoch + opt_step < {TRAIN_STEPS}"""

    q["weighted_mean"] = """SELECT event_type, round(sum(value * event_id), 2) AS sum,
        CAST(sum(event_id) AS BIGINT) AS count, round(sum(value * event_id) / sum(event_id), 6) AS average
      FROM events GROUP BY event_type"""
    q["meter_allreduce"] = f"""WITH {METERS}
      SELECT name, round(sum(sum), 9) AS sum, CAST(sum(count) AS BIGINT) AS count,
        round(sum(sum) / sum(count), 9) AS average FROM meters GROUP BY name"""
    q["meter_allreduce_scaled"] = f"""WITH {METERS}
      SELECT name, round(sum(sum) / {RANKS}, 9) AS sum, round(sum(count) / CAST({RANKS} AS DOUBLE), 9) AS count,
        round(sum(sum) / sum(count), 9) AS average FROM meters GROUP BY name"""
    q["meter_gather"] = f"""WITH {METERS}
      SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY rank) - 1 AS INTEGER) AS place,
        rank, round(sum, 9) AS sum, count FROM meters"""
    q["accumulated_loss"] = f"""WITH {STEPS}
      SELECT rank, step, round(batch_loss, 9) AS batch_loss, round(fb_time, 9) AS fb_time, n FROM steps"""
    q["log_sink"] = f"WITH {STEPS} SELECT rank, step, n FROM steps"
    q["step_loss"] = f"""WITH {STEPS}
      SELECT step, round(avg(batch_loss), 9) AS batch_loss, count(*) AS n_ranks FROM steps GROUP BY step"""
    q["throughput"] = f"""WITH {STEPS}
      SELECT rank, step, round({BATCH * ACCUMULATE * SEQ} / fb_time * {RANKS}, 6) AS throughput FROM steps"""
    q["interval_loss"] = f"""WITH {STEPS}
      SELECT step // 50 AS interval, max(step) AS step, round(avg(batch_loss), 9) AS train_loss
      FROM steps GROUP BY 1 HAVING max(step) % 50 = 49"""
    q["eval_loss"] = f"""WITH {RUN_LOG}
      SELECT round(avg(loss), 9) AS loss, count(*) AS n, round(exp(avg(loss)), 9) AS perplexity
      FROM run_log WHERE batch_idx < 100"""
    q["perplexity"] = f"""WITH {RUN_LOG}
      SELECT rank, round(avg(loss), 9) AS loss, round(exp(avg(loss)), 9) AS perplexity FROM run_log GROUP BY rank"""
    q["cross_entropy"] = f"""WITH {SCORES}, masses AS (
        SELECT row_id, ln(sum(exp(logit))) - max(logit) FILTER (token_id = label) AS nll FROM scores GROUP BY row_id)
      SELECT round(avg(nll), 9) AS loss, count(*) AS n_rows FROM masses"""

    noam = """power(CAST(768 AS DOUBLE), -0.5) * least(power(CAST(greatest(step, 1) AS DOUBLE), -0.5),
        greatest(step, 1) * power(CAST(400 AS DOUBLE), -1.5))"""
    q["lr_noam"] = f"WITH {GLOBAL_STEPS} SELECT step, round({noam} * 1000, 6) AS rate FROM g"
    q["lr_cosine"] = f"WITH {GLOBAL_STEPS} SELECT step, round({_cosine('1')}, 6) AS rate FROM g"
    q["step_log"] = f"""WITH {GLOBAL_STEPS}
      SELECT step, round(batch_loss, 9) AS batch_loss, round({_cosine('1')}, 6) AS learning_rate FROM g"""

    q["cross_entropy_rows"] = q["cross_entropy"]
    q["topk_ties"] = f"""WITH {SCORES}
      SELECT row_id, token_id, logit FROM (SELECT row_id, token_id, round(logit, 1) AS logit FROM scores)
      QUALIFY rank() OVER (PARTITION BY row_id ORDER BY logit DESC) <= 5"""
    q["softmax_rows"] = f"""WITH {SCORES}
      SELECT row_id, token_id, round(prob, 6) AS prob FROM {_softmax('scores', 0.7)}"""
    q["cumulative_mass"] = f"""WITH {SCORES}
      SELECT row_id, token_id, round(sum(prob) OVER (PARTITION BY row_id ORDER BY logit DESC, token_id
        ROWS UNBOUNDED PRECEDING), 6) AS cum_prob FROM {_softmax('scores')}"""
    q["nucleus"] = f"WITH {SCORES} SELECT row_id, token_id FROM {_nucleus(_softmax('scores'), 0.5)}"
    q["decode_filter"] = f"""WITH {SCORES},
      heated AS (SELECT row_id, token_id, logit / 0.7 AS logit FROM scores),
      best AS (SELECT * FROM heated QUALIFY rank() OVER (PARTITION BY row_id ORDER BY logit DESC) <= 20),
      inner_mass AS (SELECT * FROM {_nucleus(_softmax('best'), 0.8)})
      SELECT row_id, token_id, round(prob, 6) AS prob FROM {_softmax('inner_mass')}"""
    q["decode_filter_rows"] = q["decode_filter"]
    q["nucleus_array"] = q["nucleus"]
    u = f"""(CAST(CAST('0x' || substr(md5('{SEED}:' || row_id || ':' || token_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
        / 4503599627370496"""
    q["sample_token"] = f"""WITH {SCORES}
      SELECT row_id, arg_max(token_id, ln(prob) - ln(-ln({u}))) AS token_id FROM {_softmax('scores')} GROUP BY row_id"""
    q["retain_latest"] = """SELECT model, path, step,
        row_number() OVER (PARTITION BY model ORDER BY step DESC, path DESC) <= 5 AS keep
      FROM (SELECT event_type AS model, 'out/' || event_type || '-' || event_id || '.pt' AS path, event_id AS step
        FROM events)"""

    q["stream_clean"] = q["clean_text"]
    q["stream_pack"] = f"""WITH RECURSIVE {PIECE_TRAINING}, {PLAIN}, {CLEAN},
      {_piece_encoding('clean', 'doc_id', WORDS_OR_NEWLINE)},
      flat AS (
        SELECT doc_id, pos, unnest(ids) AS id, generate_subscripts(ids, 1) AS j
        FROM occurrences JOIN found USING (word)
        UNION ALL SELECT doc_id, 1000000000, 1, 1 FROM clean),
      placed AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos, j) - 1 AS g FROM flat)
      SELECT g // 100000 AS shard_id, g % 100000 // {BLOCK} AS block_id, CAST(count(*) AS INTEGER) AS n_tokens,
        {IDS.format('id', 'g')} AS ids
      FROM (SELECT * FROM placed QUALIFY count(*) OVER (PARTITION BY g // 100000) > 1) GROUP BY 1, 2"""
    q["stream_metrics"] = f"""SELECT event_id // {RANKS} // 125 AS flush, event_id // {RANKS} AS step,
        round(avg(value / 100), 9) AS batch_loss, count(*) AS n_ranks FROM events GROUP BY 1, 2"""
    q["stream_interval_loss"] = f"""SELECT event_id // {RANKS} // 25 AS interval, max(event_id // {RANKS}) AS step,
        round(avg(value / 100), 9) AS train_loss FROM events GROUP BY 1 HAVING max(event_id // {RANKS}) % 25 = 24"""
    return q
