"""A query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, exactdedup, langid, lempelziv, packing, prefixtrie, quotes, simhash, tokenbits, tokencount, toxicity, urlfilter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(decontaminate.match(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op5_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbits.round_trip(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencount.count_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(_table(spark, sf_dir, "conversations"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.ordered(_table(spark, sf_dir, "conversations"))
    found = prefixtrie.with_ends(*prefixtrie.tree(*prefixtrie.rebuilt(turns)))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lempelziv.parse(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_packing, op3_language_id, op4_url_filter, op5_token_bits, op6_exact_dedup, op7_simhash, op8_token_counts, op9_toxicity, op10_conversations, op11_embedding_whitening, op12_prefix_trie, op13_substring_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op6_exact_dedup": OP6, "op10_conversations": OP10, "op12_prefix_trie": OP12, "op13_substring_dedup": OP13}


OP1 = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS gram
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS m FROM items WHERE len(w) > 0))
), sizes AS (SELECT DISTINCT m FROM windows
), grams AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS gram
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)
), hits AS (SELECT r, item_id, i, g.m FROM grams g JOIN windows v ON g.gram = v.gram AND g.m = v.m
), hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r
), hit_items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP6 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS FIRST)
"""

OP10 = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, role, row_number() OVER () AS r, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS x FROM conversations
), lines AS (
  SELECT conv_id, turn, r, i, length(regexp_replace(regexp_extract(x[i], '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(x[i], '^[ \t]*((?:>[ \t]*)+)', '') AS line
  FROM (SELECT conv_id, turn, r, x, unnest(range(1, len(x) + 1)) AS i FROM raw)
), marked AS (
  SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS p
  FROM (SELECT *, lag(level) OVER (PARTITION BY r ORDER BY i) AS before FROM lines)
), pass AS (
  SELECT conv_id, turn, level, translate(trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS passage
  FROM marked GROUP BY conv_id, turn, r, p, level
), links AS (
  SELECT q.conv_id, q.turn, max(s.turn) AS parent FROM pass q JOIN pass s ON q.conv_id = s.conv_id AND q.level = s.level + 1 AND q.passage = s.passage AND s.turn < q.turn
  WHERE q.passage <> '' GROUP BY q.conv_id, q.turn
), up AS (
  SELECT conv_id, turn, parent AS above, 1 AS depth FROM links
  UNION ALL SELECT u.conv_id, u.turn, l.parent, u.depth + 1 FROM up u JOIN links l ON u.conv_id = l.conv_id AND u.above = l.turn
), roots AS (SELECT conv_id, turn, min(above) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn
), bare AS (
  SELECT r, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS text FROM lines GROUP BY r
), joined AS (
  SELECT raw.conv_id, raw.turn, raw.role, l.parent AS parent_turn, coalesce(o.root, raw.turn) AS thread_turn, CAST(coalesce(o.depth, 0) AS INTEGER) AS depth, bare.text
  FROM raw JOIN bare USING (r) LEFT JOIN links l ON raw.conv_id = l.conv_id AND raw.turn = l.turn LEFT JOIN roots o ON raw.conv_id = o.conv_id AND raw.turn = o.turn
)
SELECT conv_id, turn, role, parent_turn, thread_turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text) - 1 AS place, text FROM joined
"""

OP12 = r"""
WITH RECURSIVE msgs AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), bytes AS (
  SELECT c, CAST(4294967295 AS BIGINT) AS crc, CAST(c AS VARCHAR) AS rest, 0 AS bit FROM (SELECT DISTINCT c FROM msgs)
  UNION ALL SELECT c, CASE WHEN bit = 0 THEN xor(crc, ascii(rest)) ELSE CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END END, CASE WHEN bit = 8 THEN substr(rest, 2) ELSE rest END, (bit + 1) % 9 FROM bytes WHERE rest <> ''
), heads AS (SELECT c, c - c % 100 AS donor, CAST(xor(crc, 4294967295) % 6 AS BIGINT) AS h FROM bytes WHERE rest = ''
), sizes AS (SELECT c, count(*) AS n FROM msgs GROUP BY c
), got AS (SELECT heads.*, least(h, coalesce(d.n, 0)) AS g, least(h, coalesce(d.n, 0)) + greatest(s.n - h, 0) AS len FROM heads JOIN sizes s USING (c) LEFT JOIN sizes d ON d.c = heads.donor
), turns AS (
  SELECT got.c, pos AS d, role, text FROM got JOIN msgs ON msgs.c = donor WHERE pos <= h
  UNION ALL SELECT got.c, pos - h + g, role, text FROM got JOIN msgs ON msgs.c = got.c WHERE pos > h
), pre AS (
  SELECT c, d, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM got
), nodes AS (SELECT d, path, min(c) AS c, count(*) AS n, max(chars) AS chars FROM pre GROUP BY d, path
), owned AS (SELECT p.c AS member, p.d, n.c, n.n FROM pre p JOIN nodes n ON p.d = n.d AND p.path = n.path
), up AS (SELECT n.c, n.d, o.c AS parent FROM nodes n LEFT JOIN owned o ON o.member = n.c AND o.d = n.d - 1
), kids AS (SELECT parent AS c, d - 1 AS d, count(*) AS k FROM up WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT o.c, o.d, CAST(count(*) FILTER (WHERE k IS NULL) AS BIGINT) AS leaves, CAST(sum((n.n - 1) * n.chars) AS BIGINT) AS saved
  FROM nodes n JOIN owned o ON o.member = n.c AND o.d <= n.d LEFT JOIN kids ON kids.c = n.c AND kids.d = n.d GROUP BY o.c, o.d
), ends AS (SELECT o.c, o.d, sha256(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member)) AS e FROM owned o JOIN got ON member = got.c AND o.d = len GROUP BY o.c, o.d
)
SELECT n.c AS conv_id, n.d AS depth, parent AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes n JOIN up USING (c, d) JOIN below USING (c, d) LEFT JOIN kids USING (c, d) LEFT JOIN ends USING (c, d)
"""

OP13 = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (SELECT doc_id, r, i, array_to_string(w[i : i + 19], ' ') AS gram FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)
), firsts AS (SELECT doc_id, r, i, min({'k': doc_id IS NOT NULL, 'd': doc_id, 'i': i}) OVER (PARTITION BY gram) AS f FROM starts
), gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM firsts WHERE f <> {'k': doc_id IS NOT NULL, 'd': doc_id, 'i': i}
), words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs
), kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""
