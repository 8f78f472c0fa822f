"""The registered queries of this folder and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch_dir, table


def op1_chunk_recipe_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.dedup import exact_duplicates
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op2_bloom_cascade_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.urlfilter import RULES, judge, rule_table
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


def op6_lempel_ziv_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substrings import remove_duplicate_spans
    out = remove_duplicate_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.wavelet import read_documents, write_tokens
    path = scratch_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)


def op8_entropy_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import scan
    return scan(table(spark, sf_dir, "documents"))


def op9_collision_counting_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neighbours import nearest
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import scored
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.divergence import source_divergence
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.tensored import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.periodic import described, periodic_runs, with_planted_tails
    docs = table(spark, sf_dir, "documents")
    return described(periodic_runs(docs.withColumn("text", with_planted_tails(F.col("doc_id"), F.col("text")))))


QUERIES = {f.__name__: f for f in (
    op1_chunk_recipe_exact_dedup, op2_bloom_cascade_url_filter, op3_cost_balanced_packing, op4_ngram_jaccard_join,
    op5_source_mix,
    op6_lempel_ziv_substring_dedup, op7_wavelet_token_files, op8_entropy_secret_scan,
    op9_collision_counting_neighbours, op10_positive_unlabelled_quality, op11_source_divergence_audit,
    op12_tensored_minhash, op13_periodic_runs)}

SQL_OP1 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
             row_number() OVER w = 1 AS kept
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM k
"""

SQL_OP5 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)
                  AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
             coalesce(sum(3 * source_size) OVER l, 0) AS full_, coalesce(sum(w) OVER l, 0.0) AS w_full
      FROM p WINDOW l AS (ORDER BY 3 * source_size / w, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - full_)::DOUBLE / (w_all - w_full) AS own FROM o),
c AS (SELECT arg_min(own, w_full) AS common FROM v WHERE own * w <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, common * w) AS target FROM v, c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
j AS (SELECT d.doc_id, d.size, r.*, sha256('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS hash
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
e AS (SELECT j.*, i AS draw, CAST(floor(rate) AS BIGINT)
             + CASE WHEN CAST('0x' || substr(hash, 1 + 8 * i, 8) AS BIGINT) / 4294967296.0::DOUBLE
                         < rate - floor(rate) THEN 1 ELSE 0 END AS copies
      FROM j, range(8) AS x(i)),
b AS (SELECT source, draw, abs(sum(size * copies)::DOUBLE - min(target)) AS off_ FROM e GROUP BY source, draw),
n AS (SELECT source, arg_min(draw, (off_, draw)) AS draw FROM b GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies
FROM e JOIN n ON e.source IS NOT DISTINCT FROM n.source AND e.draw = n.draw
"""

SQL_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS class_id FROM n),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
       coalesce(c.class_id, d.doc_id) AS class_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON d.doc_id = m.x
"""

SQL_OP6 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                      lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM win JOIN f USING (k) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _oracle() -> dict[str, str]:
    from tessera.llm import divergence, tensored, urlfilter
    return {"op1_chunk_recipe_exact_dedup": SQL_OP1, "op2_bloom_cascade_url_filter": urlfilter.SQL,
            "op4_ngram_jaccard_join": SQL_OP4, "op5_source_mix": SQL_OP5, "op6_lempel_ziv_substring_dedup": SQL_OP6,
            "op11_source_divergence_audit": divergence.SQL, "op12_tensored_minhash": tensored.SQL}


ORACLE: dict[str, str] = _oracle()
