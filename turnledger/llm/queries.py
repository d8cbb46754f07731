"""The queries opN_<name>, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnledger.llm import (
    ann_partitions,
    curriculum,
    decontaminate,
    kd_shards,
    lattice_lm,
    packing,
    pii_crf,
    ptolemaic,
    quality,
    rollups,
    secret_scan,
    simhash,
    whitening,
)
from turnledger.llm.common import WORDS, keep, table, text_or_empty
from turnledger.storage import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_partitions.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_crf.find(docs, pii_crf.fit(docs))


@query
def op4_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(table(spark, sf_dir, "documents"), lattice_lm.load_lattice())


@query
def op5_benchmark_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query
def op6_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


# How the second version of the counted tokenizer cuts: words and single signs.
WORDS_AND_SIGNS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"


@query
def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in with counts of version 1; documents labelled toxic go; the
    others that are not English are counted anew with version 2; the deletion is sent
    once more, as by a job that repeats."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    counted = keep(
        table(spark, sf_dir, "documents")
        .select(
            "doc_id", "source", "lang",
            F.regexp_count(text_or_empty(), F.lit(WORDS)).alias("v1"),
            F.regexp_count(text_or_empty(), F.lit(WORDS_AND_SIGNS)).alias("v2"),
        )
        .join(toxic.withColumn("toxic", F.lit(True)), "doc_id", "left")
    )
    gone, stays = counted.filter("toxic"), counted.filter("toxic IS NULL")
    rollup = rollups.Rollup(spark, staging_path(spark, "rollup"))
    rollup.commit("insert", rollups.deltas(counted, F.col("v1"), "words-1", 1))
    rollup.commit("delete", rollups.deltas(gone, F.col("v1"), "words-1", -1))
    anew = stays.filter("lang != 'en'")
    rollup.commit("recount", rollups.revised(anew, (F.col("v1"), "words-1"), (F.col("v2"), "words-2")))
    rollup.commit("delete", rollups.deltas(gone, F.col("v1"), "words-1", -1))
    return rollup.totals()


ORACLES["op8_token_rollups"] = r"""
SELECT source, lang, tokenizer, count(*) AS documents, sum(tokens)::BIGINT AS tokens
FROM (
  SELECT source, lang,
    CASE WHEN lang <> 'en' THEN 'words-2' ELSE 'words-1' END AS tokenizer,
    CASE WHEN lang <> 'en'
      THEN len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]'))
      ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS tokens
  FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
)
GROUP BY source, lang, tokenizer
"""


@query
def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.in_training_order(curriculum.mix(table(spark, sf_dir, "documents")))
    first = F.round(F.get("positions", F.lit(0)), 6)
    return mixed.select("*", first.alias("position")).drop("positions")


ORACLES["op10_curriculum_mix"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS hash,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, rank % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM sources
), rounds AS (
  -- What is left after each round of cutting sources above three times their size.
  SELECT 0 AS round, source, source_size, rank, weight, total, false AS cut,
    total / sum(weight) OVER () AS level
  FROM weighed
  UNION ALL
  SELECT round + 1, source, source_size, rank, weight, total, now_cut,
    CASE WHEN sum(CASE WHEN now_cut THEN 0 ELSE weight END) OVER () = 0 THEN level ELSE
      (total - sum(CASE WHEN now_cut THEN 3 * source_size ELSE 0 END) OVER ())
      / sum(CASE WHEN now_cut THEN 0 ELSE weight END) OVER () END
  FROM (SELECT *, cut OR level * weight > 3 * source_size AS now_cut FROM rounds)
  WHERE round < (SELECT count(*) FROM sources)
), goal AS (
  SELECT source, source_size, rank,
    CASE WHEN cut THEN 3.0 * source_size ELSE least(level * weight, 3.0 * source_size) END AS target
  FROM rounds WHERE round = (SELECT max(round) FROM rounds)
), placed AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, g.rank,
    CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0) ELSE 0.0 END AS ratio,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.size ROWS UNBOUNDED PRECEDING)
      - s.size / 2.0 AS middle
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), taken AS (
  SELECT *, floor(ratio) + CASE WHEN middle < (ratio - floor(ratio)) * source_size THEN 1 ELSE 0 END AS copies
  FROM placed
)
SELECT doc_id, source, size, source_size, target::DOUBLE AS target, copies::INTEGER AS copies,
  (copies * size)::BIGINT AS taken,
  -- Over the whole training the weights of the three schedules are single lines.
  CASE WHEN copies > 0 THEN round(least(greatest(CASE rank % 3
    WHEN 0 THEN 2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0)))
    WHEN 1 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * share))
    ELSE share END, 0), 1), 6) END AS position
FROM (SELECT *, CASE WHEN target > 0 THEN least(middle / target, 1.0) END AS share FROM taken)
"""


@query
def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op12_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ptolemaic.clustered(table(spark, sf_dir, "embeddings"))


def _sql_rounds(rounds: int) -> str:
    """Assignment and means, written out round by round."""
    apart = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = []
    for i in range(rounds + 1):
        # The nearest centroid and, of equally near ones, the smallest: one number for both.
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, min({apart} * 16 + k) AS nearest
  FROM kept CROSS JOIN c{i} GROUP BY row
)""")
        if i < rounds:
            parts.append(f"""
m{i} AS (
  SELECT k, d, sum(v) AS s, count(*) AS n
  FROM (SELECT nearest % 16 AS k, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM a{i})
  GROUP BY k, d
),
c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(any_value(mean), any_value(c)) AS c
  FROM c{i} LEFT JOIN (
    SELECT k, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY d) AS mean FROM m{i} GROUP BY k
  ) USING (k) GROUP BY k
)""")
    return ",".join(parts)


ORACLES["op12_ptolemaic_clusters"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS k, x AS c
  FROM kept QUALIFY k < 16
),{_sql_rounds(3)},
done AS (SELECT vec_id, (nearest % 16)::INTEGER AS cluster, nearest // 16 AS distance FROM a3)
SELECT vec_id, cluster, distance,
  sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM done JOIN c3 ON k = cluster
"""


@query
def op13_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.assign(table(spark, sf_dir, "documents"))
