"""DuckDB SQL of the operators that SQL can express over whole tables: 4, 6 and 8.

Written from the contracts, not from the operators: windows and shingles are strings of
words (joined by a character that no word holds), sets are joined shingle by shingle,
components are a recursive closure.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK_WORD = r"[^\x20\x09-\x0D]+"
_PHRASE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(column: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({column}, '')"
    if lower:
        text = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    return f"regexp_extract_all({text}, '{pattern}')"


ORACLE = {}

ORACLE["op4_benchmark_decontamination"] = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words('text', _PHRASE_WORD, True)} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS p
  FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(k) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM phrase),
doc AS (SELECT doc_id, {_words('text', _PHRASE_WORD, True)} AS w FROM documents),
spot AS (
  SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS p
  FROM doc, size, unnest(range(1, len(w) - n + 2)) AS u(k)),
hit AS (SELECT spot.doc_id, spot.n, k, item_id FROM spot JOIN phrase USING (n, p)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM hit, unnest(range(k, k + n)) AS u(pos) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

ORACLE["op6_minhash_near_dedup"] = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_words('text', _BLANK_WORD, True)} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + least(3, len(w)) - 1), ' ') AS s
  FROM doc, unnest(range(1, greatest(len(w) - 1, 2))) AS u(k) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y),
least_id AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, least(doc.doc_id, coalesce(low, doc.doc_id)) AS component_id,
       doc.doc_id <= coalesce(low, doc.doc_id) AS kept
FROM doc LEFT JOIN size ON size.doc_id = doc.doc_id LEFT JOIN least_id ON least_id.doc_id = doc.doc_id"""

ORACLE["op8_substring_dedup"] = f"""
WITH doc AS (SELECT doc_id, {_words('text', _BLANK_WORD, False)} AS w FROM documents),
spot AS (
  SELECT doc_id, k, array_to_string(list_slice(w, k, k + 19), ' ') AS p FROM doc, unnest(range(1, len(w) - 18)) AS u(k)),
later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY p ORDER BY doc_id, k) AS no FROM spot) WHERE no > 1),
gone AS (SELECT doc_id, list(DISTINCT pos) AS g FROM later, unnest(range(k, k + 20)) AS u(pos) GROUP BY doc_id),
word AS (
  SELECT doc_id, pos, w[pos] AS word, g IS NOT NULL AND list_contains(g, pos) AS off
  FROM doc LEFT JOIN gone USING (doc_id), unnest(range(1, len(w) + 1)) AS u(pos)),
kept AS (
  SELECT doc_id, count_if(off) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT off) AS t FROM word GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)"""


def _crc_table() -> list[int]:
    """The 256 entries of the reflected CRC-32 (polynomial 0xEDB88320), by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


_HEX60 = "CAST('0x' || left(md5({}), 15) AS BIGINT)"

# The order of the histogram sort, its byte prefix sums and the law applied directly.
ORACLE["op10_histogram_sort"] = f"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         {_HEX60.format("coalesce(text, '')")} AS a, {_HEX60.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS b
  FROM documents),
cut AS (
  SELECT *, CAST(8 * (coalesce(sum(size) OVER (ORDER BY a, b, doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
                                               EXCLUDE GROUP), 0)) // sum(size) OVER () AS INTEGER) AS shard
  FROM doc),
crc AS (
  SELECT doc_id, t, xor(4294967295, list_reduce(
    list_transform(range(strlen(t)), lambda i: CAST('0x' || substr(hex(t), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32
  FROM (SELECT DISTINCT doc_id, t FROM doc))
SELECT cut.doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY a, b, cut.doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut JOIN crc ON cut.doc_id IS NOT DISTINCT FROM crc.doc_id AND cut.t = crc.t"""
