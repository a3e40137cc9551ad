"""The registered queries of this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, importance, infill, licenses, packing, quality, sharding, simhash, suffix_dedup, toxicity, warc, \
    window_dedup
from .common import documents, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.near_groups(documents(spark, sf_dir))
    return g.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels")).drop("failed_rules")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep WHERE c > 1) GROUP BY rid),
f AS (SELECT w.rid, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines,
             length(regexp_replace(t, '[^!?|#*$%&<>{}\[\]=_~^\\]+', '', 'g')) AS n_marks,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS r1,
             CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS r2,
             CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS r3,
             CASE WHEN n_words > 0 THEN n_marks::DOUBLE / n_words ELSE 0 END AS r4,
             CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END AS r5,
             CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS r6 FROM f),
rules AS (SELECT rule, unnest(cs) AS c, unnest(range(0, len(cs))) AS i FROM (VALUES
             (1, [0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005]::DOUBLE[]), (2, [0.5, 0.3, 0.2, 0.1, 0.05, 0.02]::DOUBLE[]),
             (3, [0.4, 0.3, 0.2, 0.1, 0.05, 0.02]::DOUBLE[]), (4, [0.5, 0.3, 0.2, 0.1, 0.05]::DOUBLE[]),
             (5, [0.5, 0.3, 0.2, 0.1]::DOUBLE[]), (6, [15.0, 12.0, 10.0, 9.0, 8.0]::DOUBLE[])) AS v(rule, cs)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
hold AS (SELECT r.*, md5(doc_id::VARCHAR)[1] < '8' AS explore FROM r SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
long AS (SELECT rid, lang, explore, unnest([1, 2, 3, 4, 5, 6]) AS rule, unnest([r1, r2, r3, r4, r5, r6]) AS x FROM hold),
strata AS (SELECT lang, count(*) AS n FROM hold WHERE NOT explore GROUP BY lang),
seen AS (SELECT lang, rule, i, count(*) AS k FROM long JOIN rules USING (rule) WHERE explore AND x > c GROUP BY lang, rule, i),
path AS (SELECT s.lang, s.n, rules.rule, rules.i, rules.c,
                row_number() OVER (PARTITION BY s.lang ORDER BY coalesce(seen.k, 0), rules.i, rules.rule) - 1 AS pos
         FROM strata AS s CROSS JOIN rules LEFT JOIN seen ON seen.lang IS NOT DISTINCT FROM s.lang AND seen.rule = rules.rule AND seen.i = rules.i),
falls AS (SELECT l.rid, l.lang, min(p.pos) AS pos FROM long AS l JOIN path AS p ON l.lang IS NOT DISTINCT FROM p.lang AND l.rule = p.rule AND l.x > p.c
          WHERE NOT l.explore GROUP BY l.rid, l.lang),
lost AS (SELECT p.lang, p.pos, p.n, (SELECT count(*) FROM falls AS f WHERE f.lang IS NOT DISTINCT FROM p.lang AND f.pos <= p.pos) AS k FROM path AS p),
level AS (SELECT 0.05 / count(*) AS v, 0.01 AS p FROM strata),
fails AS (SELECT lang, min(pos) AS pos FROM lost, level WHERE NOT (k <= n * p AND list_sum(list_transform(range(0, k::BIGINT + 1),
            lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)))) <= v) GROUP BY lang),
cut AS (SELECT p.lang, p.rule, min(p.c) AS c FROM path AS p LEFT JOIN fails AS f ON f.lang IS NOT DISTINCT FROM p.lang
        WHERE f.pos IS NULL OR p.pos < f.pos GROUP BY p.lang, p.rule),
bad AS (SELECT DISTINCT a.rid FROM (SELECT rid, lang, unnest([1, 2, 3, 4, 5, 6]) AS rule,
                                           unnest([r1, r2, r3, r4, r5, r6]) AS x FROM r) AS a
        JOIN cut ON a.lang IS NOT DISTINCT FROM cut.lang AND a.rule = cut.rule AND a.x > cut.c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept
FROM r
"""


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("stamp")


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_report(spark, table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM keep AND keep IS NOT NULL THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM f
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.assign_shards(documents(spark, sf_dir), "doc_id", "text", 24)
    return s.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.restore(infill.transform(documents(spark, sf_dir)))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
             array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM p
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT rid, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
eight AS (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
          FROM (SELECT unnest(range(0, 256)) AS i)),
tab AS (SELECT list(c ORDER BY i) AS tab FROM eight),
v AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(1, len(hex(w)), 2), lambda k: ('0x' || hex(w)[k:k + 1])::BIGINT),
                 lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]), 4294967295)) % 10000 AS bucket
      FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN v USING (w) GROUP BY bucket),
g AS (SELECT r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
                  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT unnest(range(0, 10000)) AS bucket) AS r LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
x AS (SELECT rid, sum(gain)::BIGINT AS total FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY rid),
q AS (SELECT doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(total::DOUBLE / len(w))::BIGINT END AS weight,
             ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
      FROM d LEFT JOIN x USING (rid)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM q),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place
      FROM z)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM z WHERE n_features >= 20) THEN place END AS rank
FROM r
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.removal_report(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS g
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) > 19)),
late AS (SELECT rid, i, rank() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS r FROM win),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS k FROM late WHERE r > 1),
words AS (SELECT rid, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, k) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_rules, op3_suffix_array_dedup, op4_exact_dedup, op5_license_scan, op6_warc, op7_byte_bpe, op8_sharding,
                                    op9_toxicity, op10_best_fit_packing, op11_fill_in_middle, op12_importance_resampling,
                                    op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op6_warc": OP6_SQL,
            "op11_fill_in_middle": OP11_SQL, "op12_importance_resampling": OP12_SQL,
            "op13_substring_dedup": OP13_SQL}
