"""The flagship: votes of the nearest training vectors on a hash split, accuracy by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.splits import is_validation, threshold_hex
from gridloom.functions.vectors import as_double, norm
from gridloom.operators import neighbours as N
from gridloom.plans.registry import query, table

NEAREST, FRACTION, SEED, TEMPERATURE = 5, 0.2, 42, 0.1


def nearest_votes(targets: DataFrame, context: DataFrame, k: int, temperature: float) -> DataFrame:
    """Softmax votes (t, label, w) of each target's k most similar context rows, ties at the k-th kept.

    Both sides: (id, v array<double> of unit length, label). Targets meet only the cells of the context that their bounds do not rule out.
    """
    found, _ = N.nearest(targets.select("id", "v"), context.select("id", "v", F.col("label").cast("int").alias("label")), k)
    return found.groupBy("t", "label").agg(F.sum(F.exp(F.col("sim") / temperature)).alias("w"))


@query(f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v,
 substr(sha256('{SEED}:' || vec_id),1,16) < '{threshold_hex(FRACTION)}' AS val FROM embeddings),
u AS (SELECT vec_id, label, val, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y*y)))) v FROM e),
p AS (SELECT t.vec_id t, c.label, round(list_sum(list_transform(list_zip(t.v, c.v), lambda z: z[1]*z[2])), 9) sim
 FROM u t, u c WHERE t.val AND NOT c.val),
r AS (SELECT *, rank() OVER (PARTITION BY t ORDER BY sim DESC) k FROM p),
w AS (SELECT t, label, sum(exp(sim / {TEMPERATURE})) w FROM r WHERE k <= {NEAREST} GROUP BY 1, 2),
s AS (SELECT t, label, round(w / sum(w) OVER (PARTITION BY t), 6) share FROM w),
b AS (SELECT t, label, row_number() OVER (PARTITION BY t ORDER BY share DESC, label) n FROM s)
SELECT CAST(u.label AS INTEGER) AS label, count(*) AS n_val, CAST(sum(CASE WHEN b.label = u.label THEN 1 ELSE 0 END) AS BIGINT) AS n_right,
 round(avg(CASE WHEN b.label = u.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM b JOIN u ON u.vec_id = b.t WHERE b.n = 1 GROUP BY u.label
""")
def hash_split_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1, SCL22, WIN2, WIN3, SRT6 and AGG3 in one plan."""
    v = as_double(F.col("embedding"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", v.alias("v"))
    n = norm(F.col("v"))
    e = e.select("id", "label", F.transform("v", lambda x: x / n).alias("v"), is_validation(F.col("id"), FRACTION, SEED).alias("val"))
    votes = nearest_votes(e.where("val"), e.where("not val"), NEAREST, TEMPERATURE)
    share = F.round(F.col("w") / F.sum("w").over(W.partitionBy("t")), 6)
    best = votes.withColumn("share", share).groupBy("t").agg(F.min(F.struct((-F.col("share")).alias("s"), "label")).alias("b"))
    right = (F.col("b.label") == F.col("label")).cast("int")
    return (
        best.join(e.select(F.col("id").alias("t"), "label"), "t")
        .groupBy("label")
        .agg(F.count("*").alias("n_val"), F.sum(right).cast("bigint").alias("n_right"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))
    )


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM e),
p AS (SELECT t.vec_id t, c.vec_id AS near, round(list_dot_product(t.v, c.v), 9) sim FROM u t, u c WHERE t.vec_id % 5 = 0 AND c.vec_id % 5 <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY t ORDER BY sim DESC) k FROM p)
SELECT t, near, sim FROM r WHERE k <= 3
""")
def pivot_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI11, WIN2: the three nearest of four fifths of the vectors for each other one, by cells around pivots."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", as_double(F.col("embedding")).alias("v"))
    n = norm(F.col("v"))
    e = e.select("id", "label", F.transform("v", lambda x: x / n).alias("v"))
    found, _ = N.nearest(e.where("id % 5 = 0"), e.where("id % 5 <> 0"), 3, pivots=16)
    return found.select("t", "near", "sim")
