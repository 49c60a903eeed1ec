"""DuckDB SQL of the registered queries; each states the whole rule on the given tables."""

from __future__ import annotations

from .line_dedup import MIN_LENGTH
from .mixing import GRID, Mix
from .quality import COMMON_WORDS, Rules
from .substring_dedup import WINDOW

ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


ORACLES["op1_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, row_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (SELECT *, {lowered(f"trim(line, {BLANKS})")} AS key FROM lines
), many AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {MIN_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (SELECT k.*, coalesce(k.doc_id > m.first, false) AS drops FROM keyed k LEFT JOIN many m USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (drops) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drops), '')) AS kept_sha256
FROM marked GROUP BY row_id"""

HIT_CTES = f"""
d AS (SELECT row_id, doc_id, coalesce(regexp_extract_all({lowered('text')}, '{PLAIN}'), []) AS w FROM numbered),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({lowered('text')}, '{PLAIN}'), []) AS w FROM benchmark),
bs AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bs)),
sizes AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT row_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT row_id, item, dw.n, i FROM dw JOIN wins ON dw.n = wins.n AND dw.win = wins.win),
hits AS (SELECT DISTINCT row_id, p FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM found)),
hit AS (SELECT row_id, count(*) AS n_hit FROM hits GROUP BY row_id),
its AS (SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY row_id)"""
NUMBERED = "numbered AS MATERIALIZED (SELECT row_number() OVER () AS row_id, * FROM {})"
ORACLES["op4_decontaminate"] = f"""
WITH {NUMBERED.format('documents')}, {HIT_CTES}
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_id) LEFT JOIN its USING (row_id)"""

ORACLES["op11_substring_dedup"] = f"""
WITH {NUMBERED.format('documents')}, d AS (SELECT row_id, doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM numbered),
wins AS (SELECT row_id, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
late AS (SELECT row_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM wins) WHERE nth > 1),
gone AS (SELECT DISTINCT row_id, unnest(range(i, i + {WINDOW})) AS p FROM late),
words AS (SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
rest AS (SELECT row_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (row_id, p) GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN rest USING (row_id)"""

_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT)),
  lambda crc, byte: list_reduce(list_transform(range(0, 8), lambda x: CAST(x AS UBIGINT)),
    lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), CAST(4294967295 AS UBIGINT)))"""
ORACLES["op12_prefix_trie"] = f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
steps AS (
  SELECT ids.conv_id, 1 AS kind, pos, role, text FROM ids JOIN own ON own.conv_id = ids.base AND pos <= h
  UNION ALL SELECT own.conv_id, 2, pos, role, text FROM own JOIN ids USING (conv_id) WHERE pos > h),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY kind, pos) AS depth FROM steps),
paths AS (
  SELECT conv_id, 0 AS depth, 0 AS size, '' AS prefix FROM ids
  UNION ALL SELECT conv_id, depth, length(text),
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) FROM turns),
members AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (SELECT node AS conv_id, depth, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
  sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM members GROUP BY node, depth),
up AS (SELECT n.*, m.node AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
tree AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (conv_id, depth)),
sums AS (SELECT m.node AS conv_id, m.depth, count(*) FILTER (t.n_children = 0) AS n_leaves, CAST(sum(t.saved) AS BIGINT) AS saved_tokens
  FROM tree t JOIN members m ON m.conv_id = t.conv_id AND m.depth <= t.depth GROUP BY m.node, m.depth)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM tree JOIN sums USING (conv_id, depth)"""

_R = Rules()
_CLASSES = (
    "[a-z]", "[A-Z]", r"[^\x00-\x7F]", "[0-9]", r"[\x20\x09-\x0D]", r"""[.,;:!?\x27"()-]""",
    r"""[\x00-\x08\x0E-\x1F#$%&*+/<=>@\[\\\]^_`{|}~\x7F]""",
)
_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in _CLASSES)
_COMMON = ", ".join(f"('{lang}', {i}, '{w}')" for lang, words in COMMON_WORDS.items() for i, w in enumerate(words))
QUALITY_CTES = f"""
base AS (SELECT row_id, doc_id, coalesce(text, '') AS t, lang AS key FROM numbered),
split AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, regexp_extract_all({lowered('t')}, '{PLAIN}') AS plain FROM base),
wins AS (SELECT row_id, i, array_to_string(w[i:i + 4], ' ') AS win
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
repeats AS (SELECT row_id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT row_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY row_id, win) AS c FROM wins) WHERE c > 1)
  GROUP BY row_id),
dups AS (SELECT row_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_id, unnest(string_split(t, chr(10))) AS line FROM base) WHERE regexp_matches(line, '{WORD}') GROUP BY row_id),
common(key, cell, word) AS (VALUES {_COMMON}),
ccells AS (SELECT row_id, key, 'c' AS kind, unnest(range(0, 7)) AS cell, unnest([{_COUNTS}])::DOUBLE AS v, length(t) AS size FROM split),
tokens AS (SELECT row_id, key, word, count(*) AS c FROM (SELECT row_id, key, unnest(plain) AS word FROM split) GROUP BY ALL),
wcells AS (SELECT s.row_id, s.key, 'w' AS kind, m.cell, coalesce(k.c, 0)::DOUBLE AS v, len(s.plain) AS size
  FROM split s JOIN common m USING (key) LEFT JOIN tokens k ON k.row_id = s.row_id AND k.word = m.word),
rest AS (SELECT row_id, key, kind, 999 AS cell, any_value(size) - sum(v) AS v, any_value(size) AS size FROM wcells GROUP BY row_id, key, kind),
cells AS (SELECT * FROM (FROM ccells UNION ALL FROM wcells UNION ALL FROM rest)
  WHERE size >= CASE kind WHEN 'c' THEN {_R.char_min} ELSE {_R.word_min} END AND size > 0),
ref AS (SELECT key, kind, cell, round(sum(v / size), 6) AS r FROM cells WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) >= {_R.min_documents}),
refs AS (SELECT *, r / sum(r) OVER (PARTITION BY key, kind) AS q FROM ref),
part AS (SELECT row_id, kind, v / size AS p, q, (v / size + q) / 2 AS m FROM cells JOIN refs USING (key, kind, cell)),
dist AS (SELECT row_id, kind, sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END)
  + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2)) AS js FROM part GROUP BY ALL),
wide AS (SELECT row_id, max(js) FILTER (kind = 'c') AS cd, max(js) FILTER (kind = 'w') AS wd FROM dist GROUP BY row_id),
measured AS (SELECT s.row_id, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(cd, 0) > {_R.char_limit} OR coalesce(wd, 0) > {_R.word_limit}
    OR (len(plain) >= {_R.both_min} AND coalesce(cd, 0) > {_R.both_char} AND coalesce(wd, 0) > {_R.both_word}) AS strange
  FROM split s LEFT JOIN repeats USING (row_id) LEFT JOIN dups USING (row_id) LEFT JOIN wide USING (row_id)),
judged AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.repeat_percent} * n_words AS base_failed FROM measured)"""
ORACLES["op5_quality_divergence"] = f"""
WITH {NUMBERED.format('documents')}, {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT strange AS kept
FROM judged"""

NEAR_CTES = f"""
d AS (SELECT row_id, doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{WORD}') AS w FROM numbered),
sh AS (SELECT DISTINCT row_id, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT row_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT row_id, count(*) AS n FROM sh GROUP BY row_id),
both_ AS (SELECT x.row_id AS a, y.row_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.row_id <> y.row_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes p ON p.row_id = a JOIN sizes q ON q.row_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(row_id, seen) AS (SELECT row_id, row_id FROM d UNION SELECT b, seen FROM reach JOIN links ON a = row_id),
least_ AS (SELECT r.row_id, min(s.doc_id) AS component_id FROM reach r JOIN d s ON s.row_id = r.seen GROUP BY r.row_id)"""
ORACLES["op6_signature_join"] = f"""
WITH RECURSIVE {NUMBERED.format('documents')}, {NEAR_CTES}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN sizes USING (row_id) LEFT JOIN least_ USING (row_id)"""


def _chat(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: t.r), ''), '')"


def _mask(turns: str) -> str:
    return f"""coalesce(array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'),
      lambda i: (coalesce(list_sum(list_transform({turns}[1:i - 1], lambda t: length(t.r))), 0) + {turns}[i].h)::BIGINT || ':' ||
        (coalesce(list_sum(list_transform({turns}[1:i], lambda t: length(t.r))), 0) - 1)::BIGINT), ','), '')"""


ORACLES["op2_preference_pairs"] = f"""
WITH t AS (SELECT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
last_ AS (SELECT conv_id, max(i) AS place FROM n WHERE role = 'assistant' GROUP BY conv_id),
answers AS (SELECT n.conv_id, text AS answer FROM n JOIN last_ l ON l.conv_id = n.conv_id AND l.place = n.i),
nexts AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS rejected_id FROM answers),
sides AS (SELECT n.conv_id, n.i, rejected_id, role, text, CASE WHEN n.i = place THEN answer ELSE text END AS other
  FROM n JOIN last_ USING (conv_id) JOIN nexts USING (conv_id) JOIN answers a ON a.conv_id = rejected_id WHERE rejected_id <> n.conv_id),
marked AS (SELECT *, '<|im_start|>' || replace(role, '<|im_', '<\\|im_') || chr(10) AS head,
  replace(text, '<|im_', '<\\|im_') || '<|im_end|>' || chr(10) AS b1, replace(other, '<|im_', '<\\|im_') || '<|im_end|>' || chr(10) AS b2 FROM sides),
listed AS (SELECT conv_id, rejected_id, list({{'role': role, 'h': length(head), 'r': head || b1}} ORDER BY i) AS c,
  list({{'role': role, 'h': length(head), 'r': head || b2}} ORDER BY i) AS j, coalesce(min(i) FILTER (text <> other) - 1, count(*)) AS k
  FROM marked GROUP BY conv_id, rejected_id),
cut AS (SELECT *, c[1:k] AS p, c[k + 1:] AS cc, j[k + 1:] AS jj FROM listed)
SELECT conv_id AS pair_id, conv_id AS chosen_id, rejected_id, CAST(k AS INT) AS n_common, {_chat('p')} AS prompt, {_chat('cc')} AS chosen,
  {_chat('jj')} AS rejected, {_mask('cc')} AS chosen_mask, {_mask('jj')} AS rejected_mask FROM cut"""


def shard_ctes(shards: list[str], size: int) -> str:
    """``slots``: the table, filled claim by claim as the rule says."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    n = len(shards)
    return f"""
names(i, shard) AS (VALUES {names}),
walk AS (SELECT list(('0x' || substr(md5(shard), 1, 8))::BIGINT % {size} ORDER BY i) AS off,
  list(('0x' || substr(md5(shard), 9, 8))::BIGINT % {size - 1} + 1 ORDER BY i) AS skip FROM names),
fill(turn, slot, owner) AS (
  SELECT 0, CAST(-1 AS BIGINT), list_transform(range({size}), lambda x: CAST(-1 AS BIGINT))
  UNION ALL
  SELECT turn + 1, s, list_concat(owner[1:s], [CAST(turn % {n} AS BIGINT)], owner[s + 2:])
  FROM (SELECT turn, owner, list_filter(
      list_transform(range({size}), lambda j: (off[turn % {n} + 1] + j * skip[turn % {n} + 1]) % {size}),
      lambda p: owner[p + 1] < 0)[1] AS s
    FROM fill, walk WHERE turn < {size})
), slots AS (SELECT slot, shard FROM fill JOIN names ON i = (turn - 1) % {n} WHERE turn > 0)"""


def slot_rows(size: int, table: str) -> str:
    return f"""(SELECT *, ('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN 'n' ELSE 's' || doc_id END), 1, 15))::BIGINT % {size} AS slot
  FROM {table})"""


def shard_sql(shards: list[str], size: int) -> str:
    return f"""
WITH RECURSIVE {shard_ctes(shards, size)}
SELECT doc_id, source, CAST(d.slot AS INT) AS slot, shard FROM {slot_rows(size, 'documents')} d LEFT JOIN slots USING (slot)"""


def pipeline_sql(shards: list[str], size: int, mix: Mix = Mix(), max_coverage: float = 0.5) -> str:
    """The stages of the corpus pipeline one after another; a gap between two removed words goes with them."""
    columns = "doc_id, text, lang, source, n_chars"
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH RECURSIVE s1 AS MATERIALIZED (WITH {NUMBERED.format('documents')}, {QUALITY_CTES}
  SELECT {columns} FROM numbered WHERE row_id IN (SELECT row_id FROM judged WHERE NOT base_failed AND NOT strange)),
s2 AS MATERIALIZED (WITH RECURSIVE {NUMBERED.format('s1')}, {NEAR_CTES}
  SELECT {columns} FROM numbered LEFT JOIN least_ USING (row_id) WHERE component_id IS NULL OR coalesce(doc_id = component_id, false)),
s3 AS MATERIALIZED (WITH {NUMBERED.format('s2')}, {HIT_CTES},
  pieces AS (SELECT row_id, unnest(range(0, len(w) + 1)) AS p, regexp_split_to_array(text, '{word}') AS gaps,
    regexp_extract_all(text, '{word}') AS words FROM numbered JOIN hit USING (row_id) JOIN d USING (row_id)),
  cut AS (SELECT x.row_id, string_agg(
      CASE WHEN x.p > 0 AND h.p IS NULL THEN words[x.p] ELSE '' END || CASE WHEN h.p IS NOT NULL AND g.p IS NOT NULL THEN '' ELSE gaps[x.p + 1] END,
      '' ORDER BY x.p) AS cleaned
    FROM (SELECT * FROM pieces) x LEFT JOIN hits h ON h.row_id = x.row_id AND h.p = x.p LEFT JOIN hits g ON g.row_id = x.row_id AND g.p = x.p + 1
    GROUP BY x.row_id)
  SELECT doc_id, coalesce(cleaned, text) AS text, lang, source, CASE WHEN cleaned IS NULL THEN n_chars ELSE length(cleaned) END AS n_chars
  FROM numbered LEFT JOIN cut USING (row_id) LEFT JOIN hit USING (row_id) JOIN (SELECT row_id, len(w) AS n_w FROM d) USING (row_id)
  WHERE n_hit IS NULL OR n_hit <= {max_coverage} * n_w),
s4 AS MATERIALIZED (WITH {mix_ctes(mix, 's3')} SELECT {columns} FROM occ),
{shard_ctes(shards, size)}
SELECT {columns}, CAST(d.slot AS INT) AS slot, shard FROM {slot_rows(size, 's4')} d LEFT JOIN slots USING (slot)"""


def mix_ctes(mix: Mix, table: str = "documents") -> str:
    """``occ``: one row per reading of a row of ``table``."""
    return f"""
rows_ AS (SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key,
  coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS n_tokens,
  md5('{mix.seed}:' || CASE WHEN doc_id IS NULL THEN 'n' ELSE 's' || doc_id END || ':'
    || md5(CASE WHEN text IS NULL THEN 'n' ELSE 's' || text END)) AS row_key FROM {table}),
totals AS (SELECT source_key, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY source_key),
top AS (SELECT max(tokens) AS top FROM totals),
grid AS (SELECT k, max(pow(tokens / top, k / {GRID}.0 - 1)) AS epochs
  FROM totals, top, (SELECT unnest(range(0, {GRID} + 1)) AS k) WHERE tokens > 0 GROUP BY k),
alpha AS (SELECT min(k) / {GRID}.0 AS a FROM grid WHERE epochs <= {mix.max_epochs}),
shares AS (SELECT source_key, tokens, CASE WHEN tokens > 0 THEN floor(tokens * pow(tokens / top, a - 1) + 0.5) ELSE 0 END AS budget
  FROM totals, top, alpha),
passes AS (SELECT *, CASE WHEN tokens > 0 THEN greatest(ceil(budget / tokens), 1) ELSE 1 END AS n FROM shares),
whole_budget AS (SELECT greatest(ceil(sum(budget) / {mix.block_tokens}.0), 1) AS n_blocks FROM shares),
reads AS (SELECT r.*, p.tokens, p.budget, unnest(range(0, CAST(p.n AS BIGINT))) AS epoch FROM rows_ r JOIN passes p USING (source_key)),
keyed AS (SELECT *, md5(epoch || ':' || row_key) AS order_key FROM reads),
placed AS (SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source_key, epoch ORDER BY order_key, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS token_offset FROM keyed),
occ AS (SELECT * FROM placed WHERE (epoch = 0 AND budget >= tokens) OR token_offset < budget)"""


ORACLES["op8_temperature_mix"] = f"""
WITH {mix_ctes(Mix())}
SELECT doc_id, source, n_tokens, CAST(epoch AS INT) AS epoch, CAST(token_offset AS BIGINT) AS token_offset,
  CAST(CASE WHEN budget > 0 THEN least(floor(token_offset * n_blocks / budget), n_blocks - 1) ELSE 0 END AS BIGINT) AS block, order_key
FROM occ, whole_budget"""

ORACLES["op9_warc_revisits"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
c AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (('0x' || substr(h, i // 4 * 5 + 1, 5))::INT >> (15 - i % 4 * 5)) % 32 + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM c)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to FROM f"""
