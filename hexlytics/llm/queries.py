"""The registered queries, one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexlytics.llm import (
    fingerprints, mainhtml, mixing, multiindex, neardup, neighbours, packing, quality, repair, repeats,
    resample, secrets, sharding,
)
from hexlytics.llm.registry import query
from hexlytics.llm.tables import crc, table, utf8_bytes


@query()
def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = table(spark, sf_dir, "documents").select(
        "doc_id", (utf8_bytes(F.col("text")) + 1).alias("size"),
        crc(F.col("text")).alias("text_crc32"),
    )
    return sharding.shard(digests, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


@query()
def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.expr("id % 50 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query()
def op3_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(table(spark, sf_dir, "documents"))


@query()
def op5_odd_sketch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


@query()
def op6_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.measure(table(spark, sf_dir, "documents"))


@query()
def op7_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", (quality.fold(F.col("doc_id")) == quality.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


OP8_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '~') AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT k, sum(size)::DOUBLE AS s, 2.0 * sum(size) AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY k) - 1) % 3] AS w
  FROM sized GROUP BY k),
trial AS (
  SELECT a.k, a.s, a.cap, a.w, a.cap / a.w AS level,
         (SELECT sum(least(b.cap, b.w * (a.cap / a.w))) FROM per b) AS poured,
         (SELECT sum(b.s) * 1.5 FROM per b) AS budget
  FROM per a),
stop AS (
  SELECT max(level) FILTER (WHERE poured <= budget) AS low FROM trial),
fill AS (
  SELECT (any_value(budget) - coalesce(sum(cap) FILTER (WHERE level <= low), 0))
         / sum(w) FILTER (WHERE low IS NULL OR level > low) AS h
  FROM trial, stop),
target AS (SELECT k, s, least(cap, coalesce(w * h, cap)) AS target FROM per, fill),
line AS (
  SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY k ORDER BY size, doc_id) - 1 AS before
  FROM sized JOIN target USING (k))
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
       CAST((floor(before * rate + rate + {mixing.offset()!r})
             - floor(before * rate + {mixing.offset()!r})) * size AS BIGINT) AS taken
FROM line
"""


@query(OP8_SQL)
def op8_systematic_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query()
def op9_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    of = lambda rank: F.size(
        F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(F.encode(secrets.listed(base), "UTF-8"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query()
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return mainhtml.extract(pages).select(
        "page_id", "url", F.col("main_text").alias("text"),
        F.length("main_text").cast("long").alias("n_chars"))


# crc32 of the bytes of ``word``, step by step; a macro of this file, not a function of the engine.
CRC_STEPS = """
polynomial(n, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1
  FROM polynomial WHERE k < 8),
steps AS (SELECT list(c ORDER BY n) AS t FROM polynomial WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """crc32 of a text expression in a query over ``steps``."""
    digits = f"'0x' || substr(hex(encode({text})), 2 * i + 1, 2)"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(octet_length(encode({text}))), lambda i: CAST({digits} AS BIGINT))),
      lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)))"""


OP11_SQL = f"""
WITH RECURSIVE {CRC_STEPS},
told AS (
  SELECT 1 AS aimed, item_id AS id, text FROM benchmark
  UNION ALL SELECT 0, doc_id, text FROM documents),
numbered AS (SELECT row_number() OVER () AS r, * FROM told),
met AS (
  SELECT r, aimed, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM numbered),
bucketed AS (
  SELECT word, {crc_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM met), steps),
found AS (SELECT r, aimed, bucket FROM met JOIN bucketed USING (word)),
sums AS (
  SELECT bucket, count(*) FILTER (WHERE aimed = 0) AS s, count(*) FILTER (WHERE aimed = 1) AS t
  FROM found GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM sums),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)
                                 / ((s + 1)::DOUBLE * (all_t + 10000)))) AS g
  FROM sums, totals),
weighed AS (
  SELECT r, count(*) AS n, floor(sum(g) / count(*)) AS weight
  FROM found JOIN gain USING (bucket) WHERE aimed = 0 GROUP BY r),
scored AS (
  SELECT id AS doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(
           '0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM numbered LEFT JOIN weighed USING (r) WHERE aimed = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         10 * count(*) FILTER (WHERE n_features >= 20) OVER () // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank
FROM placed
"""


@query(OP11_SQL)
def op11_head_tail_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return resample.ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")


_COSTS = {  # per state: what keeping or giving the role it waits for costs, over the vector v0 .. v3
    0: "CASE first WHEN 's' THEN cut + v1 WHEN 'u' THEN cut + v2 END, 2 + cut + v2",
    1: "CASE first WHEN 'u' THEN cut + v2 END, 2 + cut + v2",
    2: "CASE first WHEN 'a' THEN cut + v3 END, 2 + cut + v3",
    3: "CASE first WHEN 'u' THEN cut + v2 END, 2 + cut + v2",
}
_TAKEN = ", ".join(
    f"CASE WHEN gone THEN 3 + v{s} ELSE least(3 + v{s}, {cost}) END AS t{s}" for s, cost in _COSTS.items())

OP12_SQL = f"""
WITH RECURSIVE {CRC_STEPS},
plain AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, '~') AS c, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
  FROM conversations),
dealt AS (
  SELECT place, {crc_sql("place")} % 20 AS hit FROM (SELECT DISTINCT place FROM plain), steps),
damaged AS (
  SELECT c, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM plain JOIN dealt USING (place) WHERE hit <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         substr(role, 1, 1) AS first, regexp_matches(text, '[^\x20\x09-\x0D]') AS filled
  FROM damaged),
faults AS (
  SELECT *, NOT filled AS blank,
         filled AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS duplicate,
         lag(first) OVER (PARTITION BY c ORDER BY i) AS previous
  FROM placed),
kinds AS (
  SELECT *, blank OR duplicate AS gone,
         CASE WHEN blank OR duplicate OR regexp_matches(text, '[.!?][\x20\x09-\x0D]*$')
              THEN 0 ELSE 1 END AS cut
  FROM faults),
sums AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         sum(cut) AS truncated,
         count(*) FILTER (WHERE previous IS NOT NULL AND previous || first NOT IN ('su', 'ua', 'au'))
           AS illegal
  FROM kinds GROUP BY c),
back(c, i, v0, v1, v2, v3) AS (
  SELECT c, n + 1, 0, 4, 2, 0 FROM sums
  UNION ALL
  SELECT c, i, least(t0, 2 + t2, 4 + t3), least(t1, 2 + t2, 4 + t3), least(t2, 2 + t3), least(t3, 2 + t2)
  FROM (SELECT k.c, k.i, {_TAKEN} FROM back b JOIN kinds k ON k.c = b.c AND k.i = b.i - 1)),
costs AS (
  SELECT b.c, b.i, [v0, v1, v2, v3] AS v, gone, cut, first, role, text
  FROM back b LEFT JOIN kinds k ON k.c = b.c AND k.i = b.i),
steps_on AS (
  SELECT a.*, b.v AS w FROM costs a LEFT JOIN costs b ON b.c = a.c AND b.i = a.i + 1),
walk(c, i, s, audit, kept, pending) AS (
  SELECT c, 1, 0, '', CAST([] AS VARCHAR[]), true FROM sums
  UNION ALL
  SELECT c, CASE WHEN edit = 'I' THEN i ELSE i + 1 END,
         CASE edit WHEN 'D' THEN s WHEN 'K' THEN kept_state ELSE next_state END,
         audit || coalesce(edit, ''),
         CASE edit WHEN 'K' THEN list_append(kept, role || ':' || text)
                   WHEN 'I' THEN list_append(kept, given || ':')
                   WHEN 'R' THEN list_append(kept, given || ':' || text) ELSE kept END,
         edit IS NOT NULL
  FROM (
    SELECT *, CASE
      WHEN w IS NOT NULL AND 3 + w[1 + s] = v[1 + s] THEN 'D'
      WHEN 2 + v[1 + next_state] = v[1 + s] THEN 'I'
      WHEN w IS NOT NULL AND NOT gone AND kept_state IS NOT NULL
           AND cut + w[1 + kept_state] = v[1 + s] THEN 'K'
      WHEN w IS NOT NULL AND NOT gone AND 2 + cut + w[1 + next_state] = v[1 + s] THEN 'R' END AS edit
    FROM (
      SELECT x.*, y.v, y.w, y.gone, y.cut, y.role, y.text,
             CASE WHEN s = 2 THEN 3 ELSE 2 END AS next_state,
             CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END AS given,
             CASE WHEN s = 0 AND first = 's' THEN 1 WHEN s <> 2 AND first = 'u' THEN 2
                  WHEN s = 2 AND first = 'a' THEN 3 END AS kept_state
      FROM walk x JOIN steps_on y ON y.c = x.c AND y.i = x.i WHERE pending))),
ended AS (SELECT c, audit, array_to_string(kept, chr(10)) AS lines FROM walk WHERE NOT pending)
SELECT p.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(costs.v[1], 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM plain) p LEFT JOIN sums USING (c) LEFT JOIN ended USING (c)
LEFT JOIN costs ON costs.c = p.c AND costs.i = 1
"""


@query(OP12_SQL)
def op12_rank_convergence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


@query(OP13_SQL)
def op13_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
