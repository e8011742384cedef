"""SQL for queries over ``documents`` where DuckDB can express them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    lowered = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"SELECT {key}, regexp_extract_all({lowered}, '{pattern}') AS w FROM {table}"


NEAR_DEDUP = rf"""
WITH RECURSIVE words AS ({_words("documents", "doc_id", r"[^\x20\x09-\x0D]+")}),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id,
       doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

DECONTAMINATION = rf"""
WITH words AS ({_words("documents", "doc_id", r"[0-9a-z\x{80}-\x{10FFFF}]+")}),
item_words AS ({_words("benchmark", "item_id", r"[0-9a-z\x{80}-\x{10FFFF}]+")}),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM words, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: White space of the tokenizer's pattern, as RE2 spells it.
_BLANK = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+"
_WORD = _WORD.replace("'", "''")
#: RE2 looks at nothing ahead: a mark is put before the last blank of every run that text follows.
_MARK = "chr(1114109)"
BYTE_BPE = f"""
WITH RECURSIVE tokens AS MATERIALIZED (
  SELECT from_base64(split_part(line, ' ', 1)) AS spelled, split_part(line, ' ', 2)::INTEGER AS id
  FROM read_csv('/opt/tokenizers/byte_bpe_multi_50k.tiktoken', header = false, delim = chr(9),
                quote = '', escape = '', columns = {{'line': 'VARCHAR'}})),
hexed AS MATERIALIZED (SELECT hex(spelled) AS h, id FROM tokens),
merges AS MATERIALIZED (
  SELECT a.id AS first, b.id AS second, t.id AS merged
  FROM (SELECT h, id, unnest(range(1, length(h) // 2)) AS cut FROM hexed) t
  JOIN hexed a ON a.h = substr(t.h, 1, 2 * cut) JOIN hexed b ON b.h = substr(t.h, 2 * cut + 1)),
parts AS (
  SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''),
    '([{_BLANK}])([^{_BLANK}])', {_MARK} || '\\1\\2', 'g'), {_MARK})) AS part,
    generate_subscripts(string_split(regexp_replace(coalesce(text, ''),
    '([{_BLANK}])([^{_BLANK}])', {_MARK} || '\\1\\2', 'g'), {_MARK}), 1) AS part_no
  FROM documents),
words AS MATERIALIZED (
  SELECT doc_id, part_no, unnest(regexp_extract_all(part, '{_WORD}')) AS word,
         generate_subscripts(regexp_extract_all(part, '{_WORD}'), 1) AS word_no
  FROM parts),
different AS MATERIALIZED (
  SELECT word, row_number() OVER () AS w, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
steps(w, pos, token, step) AS (
  SELECT w, pos, id, 0 FROM (
    SELECT w, h, unnest(range(0, length(h) // 2)) AS pos FROM different
    WHERE h NOT IN (SELECT h FROM hexed)) s
  JOIN hexed ON hexed.h = substr(s.h, 2 * pos + 1, 2)
  UNION ALL (
    WITH pairs AS (
      SELECT *, lead(token) OVER p AS following, lead(pos) OVER p AS next_pos
      FROM steps WINDOW p AS (PARTITION BY w ORDER BY pos)),
    best AS (
      SELECT w, min_by(struct_pack(merged := merged, pos := pos, next_pos := next_pos),
                       merged::BIGINT * 4294967296 + pos) AS pick
      FROM pairs JOIN merges ON first = token AND second = following GROUP BY w)
    SELECT p.w, p.pos, CASE WHEN p.pos = pick.pos THEN pick.merged ELSE token END, step + 1
    FROM pairs p JOIN best USING (w) WHERE p.pos <> pick.next_pos)),
pieces AS (
  SELECT w, list(token ORDER BY pos) AS ids
  FROM steps JOIN (SELECT w, max(step) AS step FROM steps GROUP BY w) USING (w, step) GROUP BY w
  UNION ALL SELECT w, [id] FROM different JOIN hexed USING (h)),
texts AS (
  SELECT doc_id, flatten(list(ids ORDER BY part_no, word_no)) AS ids
  FROM words JOIN different USING (word) JOIN pieces USING (w) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ids), 0) AS n_tokens,
       sha256(coalesce(array_to_string(ids, ','), '')) AS ids_sha256,
       sha256(coalesce(d.text, '')) AS decoded_sha256
FROM documents d LEFT JOIN texts USING (doc_id)
"""
