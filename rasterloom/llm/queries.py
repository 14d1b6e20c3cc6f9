"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import op1_bpe, op2_frames, op3_warc, op4_suffix, op5_html, op6_language, op7_minhash, op8_quality, op9_decontaminate, op10_media, op11_audit, op12_whiten, op13_rules
from .common import table


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_frames.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_suffix.suffix_dedup(table(spark, sf_dir, "documents"))


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_html.extract(table(spark, sf_dir, "pages"))


def op6_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_language.identify(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, share=80)


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_decontaminate.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_media.media_columns(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_rules.quality(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_bpe_transducer, op2_token_frames, op3_warc_archive, op4_suffix_dedup, op5_tag_paths, op6_language_centroids, op7_near_duplicates,
    op8_weak_quality, op9_decontamination, op10_media_sequences, op11_filter_audit, op12_whitening, op13_rule_cascade,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_archive": OP3, "op4_suffix_dedup": OP4, "op7_near_duplicates": OP7, "op9_decontamination": OP9, "op11_filter_audit": OP11, "op13_rule_cascade": OP13}


OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest, min(page_id) OVER (PARTITION BY b) AS f FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND f < page_id THEN f END AS refers_to
FROM q
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT doc_id, w, least(4, len(w)) AS n FROM d WHERE len(w) > 0))),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 80 * (cx.n + cy.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.doc_id WHERE r.root < u.y)
SELECT d.doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
"""


OP4 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, p, substring(h, 2 * p - 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS p FROM d WHERE length(h) >= 100)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS m FROM s) WHERE m < doc_id),
e AS (SELECT doc_id, p, p + 49 AS q, CASE WHEN p > 50 + lag(p) OVER w OR lag(p) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, k, min(p) AS a, max(q) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM g UNION ALL SELECT doc_id, max(b), NULL FROM g GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * x + 1, CASE WHEN y IS NULL THEN length(h) ELSE 2 * (y - 1 - x) END), '' ORDER BY x) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM g GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n.doc_id IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM bl)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.n, dw.p, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id),
bq AS (SELECT k, n, q, array_to_string(w[q : q + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS q FROM (SELECT *, row_number() OVER () AS k FROM bl))),
runs AS (SELECT doc_id, min(p) AS p, count(*) + n - 1 AS far FROM (SELECT doc_id, dw.n, dw.p, k, dw.p - q AS diagonal, dw.p - row_number() OVER (PARTITION BY doc_id, dw.n, k, dw.p - q ORDER BY dw.p) AS run FROM dw JOIN bq ON dw.n = bq.n AND dw.g = bq.g) GROUP BY doc_id, n, k, diagonal, run),
top AS (SELECT doc_id, far AS longest, min(p) - 1 AS longest_word FROM runs GROUP BY doc_id, far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far DESC) = 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(longest, 0)::BIGINT AS longest, longest_word::BIGINT AS longest_word
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN top USING (doc_id)
"""


OP11 = r"""
WITH l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS f FROM documents),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(f < doc_id, false)::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
s AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM s a, s b, s c, s d, s e WHERE a.b | b.b | c.b | d.b | e.b = 31),
k AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1 : i - 1]), 0)::INT AS before FROM o, range(1, 6) r(i)),
a AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, k GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM a
"""


OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS c FROM (SELECT k, p, array_to_string(w[p : p + 7], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8))),
r AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest(range(p, p + 8)) AS q FROM g WHERE c > 1) GROUP BY 1),
f AS (SELECT doc_id, t, w, l, len(w) AS n, length(array_to_string(w, '')) AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbols, len(l) AS lines, len(l) - len(list_distinct(l)) AS dup, coalesce(r.n, 0) AS repeats FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, n < 20 OR 100 * repeats > 30 * n AS base_failed FROM f)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, repeats::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * symbols > n OR chars < 2 * n OR chars > 15 * n OR 100 * dup > 40 * lines OR 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 40 * length(t)
    OR 100 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 50 * length(t) OR 100 * length(regexp_replace(t, '[^!?]', '', 'g')) > 50 * n
    OR 100 * len(list_filter(range(2, n + 1), lambda i : w[i] = w[i - 1])) > 30 * n
    OR 100 * len(list_filter(l, lambda x : regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) > 30 * lines
    OR 100 * len(list_filter(l, lambda x : regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) > 90 * lines) AS kept
FROM b
"""
