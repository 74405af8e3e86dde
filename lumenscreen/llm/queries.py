"""The registered queries of this subpackage, over the whole given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, language, licenses, line_templates, mixing, near_duplicates, packing, resampling, secrets, suffix_dedup, vector_codes, warc
from .shared import table

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((r - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, n_docs, source_size, CASE WHEN cap <= level * w THEN cap
    ELSE least(cap, (SELECT arg_min(level, cap / w) FROM l WHERE NOT cap <= level * w) * w) END AS target FROM l
), q AS (
  SELECT *, greatest(1, ceil(n_docs / 256.0))::BIGINT AS blocks, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t
), q2 AS (SELECT *, floor(target)::BIGINT - passes * source_size AS rest FROM q
), p AS (
  SELECT d.doc_id, d.size, q2.*, ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '~')), 1, 8))::BIGINT AS at,
    ('0x' || substr(md5('18|' || coalesce(d.doc_id::VARCHAR, '~')), 1, 8))::BIGINT % blocks AS block
  FROM d JOIN q2 ON d.source IS NOT DISTINCT FROM q2.source
), b AS (
  SELECT source, block, sum(size)::BIGINT AS words, ('0x' || substr(md5('19|' || coalesce(source, '~') || '|' || block::VARCHAR), 1, 8))::BIGINT AS o FROM p GROUP BY source, block
), c AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b
), x AS (
  SELECT p.*, c.before, c.words, coalesce(sum(p.size) OVER (PARTITION BY p.source, p.block ORDER BY p.at, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
  FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source AND p.block = c.block
)
-- The tree: a row is a node (shards low to high, quotas qs of all sources) with the draws of the first i sources.
, k AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
slots AS (
  SELECT source, block, draw::INT AS draw, lim FROM (
    SELECT k.source, block, unnest(range(0, passes)) AS draw, words AS lim FROM k JOIN q2 ON k.source IS NOT DISTINCT FROM q2.source
    UNION ALL
    SELECT k.source, block, passes AS draw, least(words, rest - before) AS lim FROM k JOIN q2 ON k.source IS NOT DISTINCT FROM q2.source WHERE rest > before)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('20|' || coalesce(source, '~') || '|' || block::VARCHAR || '|' || draw::VARCHAR), 1, 8))::BIGINT, block, draw) - 1 AS rank FROM slots
), quotas AS (SELECT source, count(*) AS quota FROM slots GROUP BY source),
root AS (SELECT list(coalesce(source, '~') ORDER BY source NULLS FIRST) AS names, list(quota ORDER BY source NULLS FIRST) AS qs FROM quotas),
shards AS (SELECT greatest(16, ceil(1.5 * sum(size) / 64000000))::INT AS n FROM d),
tree AS (
  SELECT 0 AS low, shards.n AS high, names, qs, 0 AS i, list_sum(qs)::BIGINT AS m, floor(list_sum(qs) * (shards.n // 2) / shards.n)::BIGINT AS left_slots, []::BIGINT[] AS lefts FROM root, shards
  UNION ALL
  SELECT nl, nh, names, nq, ni, CASE WHEN ni = 0 THEN list_sum(nq)::BIGINT ELSE nm END, CASE WHEN ni = 0 THEN floor(list_sum(nq) * ((nl + nh) // 2 - nl) / (nh - nl))::BIGINT ELSE ns END, nf FROM (
    SELECT names, CASE WHEN done AND side = 1 THEN (low + high) // 2 ELSE low END AS nl, CASE WHEN done AND side = 0 THEN (low + high) // 2 ELSE high END AS nh,
      CASE WHEN NOT done THEN qs WHEN side = 0 THEN lefts ELSE list_transform(range(1, len(qs) + 1), lambda j: qs[j] - lefts[j]) END AS nq,
      CASE WHEN done THEN 0 ELSE i + 1 END AS ni, m - qs[i + 1] AS nm, left_slots - got AS ns, CASE WHEN done THEN [] ELSE list_append(lefts, got) END AS nf
    FROM (
      SELECT *, xs[coalesce(list_filter(range(1, len(ws) + 1), lambda j: list_sum(ws[1:j]) > u * list_sum(ws))[1], 1)]::BIGINT AS got FROM (
        SELECT *, list_transform(xs, lambda x: exp(lgamma(mode + 1) + lgamma(kk - mode + 1) + lgamma(left_slots - mode + 1) + lgamma(m - kk - left_slots + mode + 1) - lgamma(x + 1) - lgamma(kk - x + 1) - lgamma(left_slots - x + 1) - lgamma(m - kk - left_slots + x + 1))) AS ws FROM (
          SELECT *, list_concat(range(mode, least(most, mode + reach) + 1), list_reverse(range(greatest(least_, mode - reach), mode))) AS xs FROM (
            SELECT *, least(most, greatest(least_, floor((left_slots + 1.0) * (kk + 1) / (m + 2))::BIGINT)) AS mode FROM (
              SELECT *, coalesce(qs[i + 1], 0) AS kk, greatest(0, left_slots + coalesce(qs[i + 1], 0) - m) AS least_, least(coalesce(qs[i + 1], 0), left_slots) AS most, i = len(qs) AS done,
                ceil(12 * sqrt(left_slots * (coalesce(qs[i + 1], 0) / greatest(m, 1)) * (1 - coalesce(qs[i + 1], 0) / greatest(m, 1))) + 24)::BIGINT AS reach, unnest([0, 1]) AS side,
                ('0x' || substr(md5('17|' || low || '|' || high || '|' || names[i + 1]), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
              FROM tree WHERE high - low > 1) WHERE side = 0 OR done)))))
), leaves AS (SELECT low AS shard, unnest(names) AS name, unnest(qs) AS quota FROM tree WHERE high - low = 1 AND i = 0),
ends AS (SELECT name, shard, sum(quota) OVER (PARTITION BY name ORDER BY shard) AS e FROM leaves),
dealt AS (SELECT source, block, draw, lim, (SELECT count(*) FROM ends WHERE name = coalesce(source, '~') AND e <= rank) AS shard FROM ranked),
taken AS (
  SELECT x.doc_id, x.size, x.source_size, x.target, x.at, dealt.draw, dealt.shard, greatest(0, least(x.size, lim - pre))::BIGINT AS got FROM x LEFT JOIN dealt ON x.source IS NOT DISTINCT FROM dealt.source AND x.block = dealt.block
)
SELECT doc_id, size, source_size, target::DOUBLE AS target, coalesce(sum(got), 0)::BIGINT AS taken,
  coalesce(string_agg(shard || ':' || draw || ':' || got, ',' ORDER BY draw, shard) FILTER (draw IS NOT NULL AND (got > 0 OR size = 0)), '') AS draws
FROM taken GROUP BY doc_id, size, source_size, target
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT html, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN m IS NOT NULL AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(0, greatest(1, len(w) - 12)), lambda i: list_aggregate(w[i + 1 : i + 13], 'string_agg', ' '))) AS win FROM b WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS pos, unnest(list_transform(range(0, len(w) - n + 1), lambda i: list_aggregate(w[i + 1 : i + n], 'string_agg', ' '))) AS win
  FROM d, lens WHERE len(w) >= n
), hits AS (SELECT doc_id, pos, dw.n, item_id FROM dw JOIN bw USING (win)),
words AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS k FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(0, len(w) - 2), lambda i: list_aggregate(w[i + 1 : i + 3], 'string_agg', ' ')) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
m AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(root, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=3)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT *, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS spaced FROM l),
c AS (SELECT doc_id, string_agg(spaced, chr(10) ORDER BY pos) AS copy FROM s WHERE spaced <> '' GROUP BY doc_id),
m AS (SELECT doc_id, pos, copy, regexp_replace(spaced, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM s JOIN c USING (doc_id) WHERE spaced <> ''),
r AS (SELECT *, (len(string_split(line, ' ')), string_split(line, ' ')[1:3]) AS leaf, (coalesce(lag(line) OVER w, ''), coalesce(lead(line) OVER w, '')) AS context FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
alone AS (SELECT line, min(doc_id) AS first_doc FROM r GROUP BY line HAVING count(DISTINCT copy) >= 8),
crowded AS (SELECT leaf FROM r GROUP BY leaf HAVING count(DISTINCT context) >= 8),
d AS (SELECT DISTINCT line, leaf FROM r JOIN crowded USING (leaf)),
t AS (SELECT *, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS place FROM d),
k AS (SELECT leaf, place, token, count(*) AS n FROM t GROUP BY ALL),
o AS (SELECT *, n / sum(n) OVER (PARTITION BY leaf, place) AS share, row_number() OVER (PARTITION BY leaf, place ORDER BY n DESC, token DESC) AS rank FROM k),
f AS (SELECT leaf, place, CASE WHEN share >= 0.6 AND token <> '<*>' THEN token END AS form FROM o WHERE rank = 1),
trees AS (SELECT leaf FROM f GROUP BY leaf HAVING count(form) >= 0.5 * count(*)),
named AS (SELECT line, leaf FROM t JOIN f USING (leaf, place) WHERE leaf IN (SELECT leaf FROM trees) GROUP BY ALL HAVING bool_and(form IS NULL OR form = token)),
recurring AS (SELECT leaf, min(doc_id) AS first_doc FROM r JOIN named USING (line, leaf) GROUP BY leaf HAVING count(DISTINCT context) >= 8),
found AS (SELECT line, min(first_doc) AS first_doc FROM (SELECT line, first_doc FROM alone UNION ALL SELECT line, first_doc FROM named JOIN recurring USING (leaf)) GROUP BY line),
gone AS (SELECT doc_id, pos FROM r JOIN found USING (line) WHERE doc_id <> first_doc),
kept AS (SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped, coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN raw END, chr(10) ORDER BY l.pos), '') AS text FROM l LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)
"""


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.report(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op11_sql(rounds: int = 6) -> str:
    """Lloyd's rounds unrolled; the smallest of 16 * distance + entry gives both."""
    out = """WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM (SELECT *, unnest(range(8)) AS part FROM k)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS r FROM p) WHERE r <= 16)"""
    for i in range(rounds + 1):
        out += f""",
a{i} AS MATERIALIZED (
  SELECT vec_id, part, any_value(x) AS x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT * 16 + entry) AS m FROM p JOIN b{i} USING (part) GROUP BY vec_id, part
)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM (
  SELECT part, m % 16 AS entry, pos, sum(x[pos])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS pos FROM a{i}) GROUP BY ALL) GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN s{i} USING (part, entry))"""
    return out + f""",
e AS (SELECT vec_id, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, sum(m // 16)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM e JOIN k USING (vec_id), h"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


# CRC-32 bit by bit for the 256 bytes, then byte by byte for each different word.
OP12_SQL = r"""
WITH tab AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)
), raw AS MATERIALIZED (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), vocabulary AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(w)), lambda i: ('0x' || hex(w)[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM raw), tab
), counts AS MATERIALIZED (SELECT side, doc_id, bucket, count(*) AS n FROM raw JOIN vocabulary USING (w) GROUP BY ALL),
bs AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM counts GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM bs) + 10000) / ((s + 1) * ((SELECT sum(t) FROM bs) + 10000))))::BIGINT AS g FROM bs),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM counts JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN weights USING (doc_id)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_ann": op2_ann,
        "op3_secrets": op3_secrets,
        "op4_language_id": op4_language_id,
        "op5_line_templates": op5_line_templates,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_warc": op7_warc,
        "op8_licenses": op8_licenses,
        "op9_mixing": op9_mixing,
        "op10_minhash": op10_minhash,
        "op11_vector_codes": op11_vector_codes,
        "op12_resampling": op12_resampling,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op5_line_templates": OP5_SQL, "op7_warc": OP7_SQL, "op9_mixing": OP9_SQL, "op10_minhash": OP10_SQL, "op11_vector_codes": _op11_sql(), "op12_resampling": OP12_SQL}
