"""Queries of labels propagated along sequences of frames; 250 consecutive vectors are a sequence of ten frames of 5 x 5 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.vectors import as_double
from gridloom.operators import propagation as P
from gridloom.plans.registry import query, table

QUEUE, REACH, TOPK, TEMPERATURE, CLASSES = 3, 2, 5, 0.1, 10

_VOTES = f"""WITH RECURSIVE e AS MATERIALIZED (
 SELECT vec_id // 250 AS sequence, vec_id % 250 // 25 AS frame, CAST(vec_id % 25 // 5 AS INTEGER) AS r, CAST(vec_id % 5 AS INTEGER) AS c, label,
 list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings),
u AS MATERIALIZED (SELECT * EXCLUDE v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM e),
p AS (SELECT t.sequence, t.frame, t.r, t.c, s.frame sf, s.r sr, s.c sc, round(list_dot_product(t.v, s.v), 9) sim FROM u t JOIN u s
 ON t.sequence = s.sequence AND (s.frame = 0 OR s.frame >= t.frame - {QUEUE}) AND s.frame < t.frame AND abs(t.r - s.r) <= {REACH} AND abs(t.c - s.c) <= {REACH}),
k AS (SELECT *, rank() OVER (PARTITION BY sequence, frame, r, c ORDER BY sim DESC) n FROM p),
votes AS MATERIALIZED (SELECT *, exp(sim / {TEMPERATURE}) / sum(exp(sim / {TEMPERATURE})) OVER (PARTITION BY sequence, frame, r, c) w FROM k WHERE n <= {TOPK}),
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence, frame, r, c, label, v) of all vectors."""
    i = F.col("vec_id")
    place = lambda x: F.floor(x).cast("int")
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(i / 250).alias("sequence"), F.floor(i % 250 / 25).alias("frame"), place(i % 25 / 5).alias("r"), (i % 5).cast("int").alias("c"), "label", as_double(F.col("embedding")).alias("v"))


def first_labels(rows: DataFrame) -> DataFrame:
    """(sequence, r, c, soft): the one-hot labels of frame 0."""
    soft = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.coalesce((k == F.col("label")).cast("double"), F.lit(0.0)))
    return rows.where("frame = 0").select("sequence", "r", "c", soft.alias("soft"))


@query(_VOTES + f"""soft AS (
 SELECT CAST(0 AS BIGINT) AS t, sequence, frame, r, c, k, CASE WHEN label = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM e, range({CLASSES}) i(k) WHERE frame = 0
 UNION ALL SELECT * FROM (
  SELECT t + 1 AS t, sequence, frame, r, c, k, x FROM soft WHERE (frame = 0 OR frame > t - {QUEUE} + 1) AND t < (SELECT max(frame) FROM e)
  UNION ALL
  SELECT v.frame, v.sequence, v.frame, v.r, v.c, s.k, sum(v.w * s.x) FROM soft s JOIN votes v ON v.frame = s.t + 1 AND v.sequence = s.sequence AND v.sf = s.frame AND v.sr = s.r AND v.sc = s.c GROUP BY ALL)),
made AS (SELECT * FROM soft WHERE frame = t),
z AS (SELECT *, min(x) OVER w AS low, max(x) OVER w AS high FROM made WINDOW w AS (PARTITION BY sequence, frame, k)),
b AS (SELECT *, row_number() OVER (PARTITION BY sequence, frame, r, c ORDER BY round(CASE WHEN high > low THEN (x - low) / (high - low) ELSE 0 END, 9) DESC, k) n FROM z)
SELECT sequence, frame, r, c, CAST(k AS INTEGER) AS label, round(x, 6) AS share FROM b WHERE n = 1
""")
def video_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3, WIN1, JOI10, JOI11, WIN2, SCL15, SRT6: the labels of frame 0 carried through all frames, with a queue of three that drops its oldest."""
    rows = frames(spark, sf_dir)
    soft = P.propagate(rows.drop("label"), first_labels(rows), QUEUE, REACH, TOPK, TEMPERATURE)
    return P.hard_labels(soft).withColumn("share", F.round("share", 6))


@query(_VOTES + "x AS (SELECT 1)\nSELECT sequence, frame, r, c, count(*) AS n, CAST(sum(sf * 100 + sr * 10 + sc) AS BIGINT) AS mark, round(max(w), 6) AS top FROM votes GROUP BY ALL")
def context_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1, WIN2, JOI10, JOI11: who votes for each pixel of every frame, in one pass over all frames."""
    votes = P.context_votes(frames(spark, sf_dir), QUEUE, REACH, TOPK, TEMPERATURE, tile=4)
    mark = F.aggregate("votes", F.lit(0).cast("bigint"), lambda s, x: s + x["frame"] * 100 + x["r"] * 10 + x["c"])
    return votes.select("sequence", "frame", "r", "c", F.size("votes").cast("bigint").alias("n"), mark.alias("mark"), F.round(F.array_max(F.transform("votes", lambda x: x["w"])), 6).alias("top"))
