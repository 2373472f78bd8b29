"""Queries of vector analytics, propagation and evaluation; grids are r = vec_id % 25, c = vec_id div 25."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.vectors import as_double, dot, norm
from gridloom.operators import features as V
from gridloom.operators import grids as G
from gridloom.operators import lowrank as LR
from gridloom.operators import metrics as M
from gridloom.plans.registry import query, table
from gridloom.sources.registry import upsampler

_V = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings),\n"
_LONG = _V + "l AS (SELECT vec_id, label, unnest(v) x, generate_subscripts(v, 1) - 1 d FROM e),\n"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", as_double(F.col("embedding")).alias("v"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.exploded(vectors(spark, sf_dir), ["vec_id", "label"], "v")


def mean_of(vector: str):
    """The mean of a vector's components, to nine digits so that the order of the sum does not show."""
    total = F.aggregate(as_double(F.col(vector)), F.lit(0.0), lambda s, x: s + x)
    return F.round(total / F.size(vector), 9)


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as images of 25 rows and 20 columns, 500 consecutive ids each; x is the mean of a vector's components."""
    e = table(spark, sf_dir, "embeddings")
    r, c = (F.col("vec_id") % 25).cast("int"), (F.floor(F.col("vec_id") / 25) % 20).cast("int")
    return e.select(F.floor(F.col("vec_id") / 500).alias("image"), r.alias("r"), c.alias("c"), mean_of("embedding").alias("x"), "label", "vec_id")


_PLANE = "WITH g AS (SELECT CAST(vec_id // 500 AS BIGINT) image, CAST(vec_id % 25 AS INTEGER) r, CAST(vec_id // 25 % 20 AS INTEGER) c, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 9) x, label, vec_id FROM embeddings)"


@query(_LONG + "m AS (SELECT label, d, avg(x) m FROM l GROUP BY 1, 2)\nSELECT l.label, CAST(l.d AS INTEGER) AS d, round(sum((0.2 * x + 0.8 * m) * (0.2 * x + 0.8 * m)), 6) AS energy FROM l JOIN m ON l.label = m.label AND l.d = m.d GROUP BY 1, 2")
def group_mean_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1 for disjoint groups."""
    p = V.group_mean_pull(long(spark, sf_dir), "label", 0.8)
    return p.groupBy("label", "d").agg(F.round(F.sum(F.col("pulled") * F.col("pulled")), 6).alias("energy"))


@query(_V + """l AS (SELECT vec_id, CAST(vec_id // 500 AS BIGINT) AS image, label, unnest(v) x, generate_subscripts(v, 1) - 1 d FROM e),
m AS (SELECT image, d, avg(x) m FROM l WHERE label < 5 GROUP BY 1, 2), a AS (SELECT l.*, CASE WHEN label < 5 THEN 0.2 * x + 0.8 * m ELSE x END y FROM l JOIN m ON m.image = l.image AND m.d = l.d),
n AS (SELECT image, d, avg(y) n FROM a WHERE vec_id % 2 = 0 GROUP BY 1, 2)
SELECT a.image, CAST(a.d AS INTEGER) AS d, round(sum(pow(CASE WHEN vec_id % 2 = 0 THEN 0.2 * y + 0.8 * n ELSE y END, 2)), 6) AS energy FROM a JOIN n ON n.image = a.image AND n.d = a.d GROUP BY 1, 2""")
def sequential_mask_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1 for overlapping masks: the second mask sees what the first has changed."""
    e = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 500).alias("image"), F.col("vec_id").alias("pixel"), "label", "v")
    masks = e.where("label < 5").select("image", F.lit(0).alias("mask"), F.col("pixel").alias("member")).unionByName(e.where("pixel % 2 = 0").select("image", F.lit(1).alias("mask"), F.col("pixel").alias("member")))
    out = V.sequential_pull(e.select("image", "pixel", "v"), masks.select(F.col("image").alias("image"), "mask", F.col("member").alias("pixel")), 0.8)
    return out.select("image", F.posexplode("v").alias("d", "x")).groupBy("image", "d").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("energy"))


@query(_LONG + "v AS (SELECT label, d, var_pop(x) v FROM l GROUP BY 1, 2)\nSELECT label, round(avg(v), 9) AS dispersion FROM v GROUP BY label")
def mask_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2, FLT4."""
    return V.dispersion(long(spark, sf_dir), "label").select("label", F.round("dispersion", 9).alias("dispersion"))


@query(_V + "m AS (SELECT vec_id, v, list_sum(v) / len(v) m, list_sum(list_transform(v, lambda x: x * x)) / len(v) q FROM e)\nSELECT vec_id, CAST(unnest(range(0, len(v))) AS INTEGER) AS d, round(unnest(list_transform(v, lambda x: (x - m) / sqrt(q - m * m + 1e-6))), 6) AS x FROM m")
def channel_layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL18."""
    n = V.layer_norm(F.col("v"))
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(n).alias("d", "x")).select("vec_id", "d", F.round("x", 6).alias("x"))


@query(_LONG + "m AS (SELECT d, min(x) lo, max(x) hi FROM l GROUP BY d)\nSELECT CAST(l.d AS INTEGER) AS d, round(sum((x - lo) / greatest(hi - lo, 1e-4) - 0.5), 6) AS total, round(max((x - lo) / greatest(hi - lo, 1e-4) - 0.5), 6) AS top FROM l JOIN m ON l.d = m.d GROUP BY l.d")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL19, SCL15."""
    return V.minmax_scale(long(spark, sf_dir)).groupBy("d").agg(F.round(F.sum("scaled"), 6).alias("total"), F.round(F.max("scaled"), 6).alias("top"))


@query("""SELECT vec_id, CAST(k AS INTEGER) AS k, round(CASE WHEN k < 10 THEN sin(p * exp(-2 + 12.0 * k / 9)) ELSE cos(p * exp(-2 + 12.0 * (k - 10) / 9)) END, 6) AS f
FROM (SELECT vec_id, -1 + 2 * (vec_id % 25) / 24.0 AS p FROM embeddings), range(20) b(k)""")
def fourier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL20 on the row coordinate of every vector."""
    at = F.lit(-1) + 2 * (F.col("vec_id") % 25) / F.lit(24.0)
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(V.fourier(at, 10)).alias("k", "f")).withColumn("f", F.round("f", 6))


_MATRIX = V.projection_matrix(64, 3)


@query(_V.rstrip(",\n") + "\nSELECT vec_id, " + ", ".join(f"round(list_dot_product(v, {m!r}::DOUBLE[]), 6) AS p{k}" for k, m in enumerate(_MATRIX)) + " FROM e")
def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL21 with a fixed matrix of unit columns."""
    p = vectors(spark, sf_dir).select("vec_id", V.project(F.col("v"), _MATRIX).alias("p"))
    return p.select("vec_id", *[F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)])


_PAIRS = _V + """u AS (SELECT vec_id, label, v[1:32] a, v[33:64] b FROM e),
n AS (SELECT vec_id, label, list_transform(a, lambda x: x / (sqrt(list_dot_product(a, a)) + 1e-6)) a, list_transform(b, lambda x: x / (sqrt(list_dot_product(b, b)) + 1e-6)) b FROM u)
SELECT p.label, round(avg(pow(list_dot_product(p.a, q.a) - list_dot_product(p.b, q.b), 2)), 9) AS mse FROM n p JOIN n q ON p.label = q.label GROUP BY p.label"""


@query(_PAIRS)
def affinity_mse_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15, AGG16: affinities of student and teacher by second moments; the oracle is the dense form."""
    e = vectors(spark, sf_dir).select("label", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    return V.affinity_gram(e, "label", "a", "b").select("label", F.round("mse", 9).alias("mse"))


@query(_LONG + """m AS (SELECT d, avg(x) m FROM l GROUP BY d)
SELECT CAST(a.d AS INTEGER) AS i, CAST(b.d AS INTEGER) AS j, round(avg(a.x * b.x) - any_value(p.m) * any_value(q.m), 9) AS cov
FROM l a JOIN l b ON a.vec_id = b.vec_id JOIN m p ON p.d = a.d JOIN m q ON q.d = b.d GROUP BY a.d, b.d""")
def pca_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL24: the covariances that principal components come from, by matrix products of whole batches."""
    m = V.second_moments(vectors(spark, sf_dir), "v", "v")
    d = F.size("sums")
    cells = m.select("n", "sums", d.alias("d"), F.posexplode("cells").alias("k", "x")).withColumn("i", F.floor(F.col("k") / F.col("d")).cast("int")).withColumn("j", (F.col("k") % F.col("d")).cast("int"))
    mean = lambda c: F.get("sums", F.col(c)) / F.col("n")
    return cells.select("i", "j", F.round(F.col("x") / F.col("n") - mean("i") * mean("j"), 9).alias("cov"))


@query()
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL24: projections on two components, scaled to 0..1 (signs are free, so no oracle; compared with a full decomposition in tests)."""
    rows = vectors(spark, sf_dir)
    mean, components, _ = V.principal_components(rows, "v", 2)
    centred = F.zip_with("v", F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    p = rows.select("vec_id", V.project(centred, [[float(x) for x in c] for c in components]).alias("p")).select("vec_id", F.get("p", F.lit(0)).alias("p0"), F.get("p", F.lit(1)).alias("p1"))
    span = p.agg(*[f(c).alias(f"{c}{n}") for c in ("p0", "p1") for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [F.round(F.try_divide(F.col(c) - F.col(f"{c}lo"), F.col(f"{c}hi") - F.col(f"{c}lo")), 6).alias(c) for c in ("p0", "p1")]
    # One row by construction.
    return p.crossJoin(F.broadcast(span)).select("vec_id", *scaled)


@query(_V.rstrip(",\n") + """, s AS (SELECT label, list_sum(list_transform(list_zip(v[1:32], v[33:64]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 32 AS m, 0.5 + label * 0.1 AS s, abs(v[1]) AS k FROM e)
SELECT label, round(avg(m), 9) AS mse, round(greatest(avg(m / (2 * s * s) + ln(s)), 0), 9) AS nll, round(-sum(greatest(k, 1e-8) * ln(greatest(k, 1e-8) + 1e-8)), 6) AS entropy FROM s GROUP BY label""")
def reconstruction_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11, AGG12, AGG14: MSE of aligned features, uncertainty-weighted likelihood, entropy."""
    diff = F.zip_with(F.slice("v", 1, 32), F.slice("v", 33, 32), lambda a, b: (a - b) * (a - b))
    s = vectors(spark, sf_dir).select("label", (F.aggregate(diff, F.lit(0.0), lambda a, x: a + x) / 32).alias("m"), (0.5 + F.col("label") * 0.1).alias("s"), F.greatest(F.abs(F.get("v", F.lit(0))), F.lit(1e-8)).alias("k"))
    nll = F.greatest(F.avg(F.col("m") / (2 * F.col("s") * F.col("s")) + F.ln("s")), F.lit(0.0))
    return s.groupBy("label").agg(F.round(F.avg("m"), 9).alias("mse"), F.round(nll, 9).alias("nll"), F.round(-F.sum(F.col("k") * F.ln(F.col("k") + 1e-8)), 6).alias("entropy"))


@query(_PLANE + ", d AS (SELECT image, lead(x) OVER (PARTITION BY image, r ORDER BY c) - x a, lead(x) OVER (PARTITION BY image, c ORDER BY r) - x b FROM g)\nSELECT image, round((coalesce(sum(a * a), 0) + coalesce(sum(b * b), 0)) / count(*), 9) AS tv FROM d GROUP BY image")
def total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13."""
    return G.total_variation(plane(spark, sf_dir)).select("image", F.round("tv", 9).alias("tv"))


@query("""WITH g AS (SELECT vec_id, label, vec_id % 25 r, vec_id // 25 c FROM embeddings)
SELECT a.vec_id, count(*) AS n, CAST(sum(b.vec_id) AS BIGINT) AS ids FROM g a JOIN g b ON a.label = b.label AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY a.vec_id""")
def band_join_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI10: neighbours within three rows and columns by bucketed equi-join."""
    g = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 25).alias("r"), F.floor(F.col("vec_id") / 25).alias("c"))
    pairs = G.band_join(g, g.select("label", "r", "c", F.col("vec_id").alias("other")), 3, "label")
    return pairs.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("other2").alias("ids"))


_PROP = _V + """u AS (SELECT vec_id, label, vec_id % 25 r, vec_id // 25 c, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM e),
p AS (SELECT t.vec_id, s.label, round(list_sum(list_transform(list_zip(t.v, s.v), lambda z: z[1] * z[2])), 9) sim FROM u t JOIN u s ON abs(t.r - s.r) <= 4 AND abs(t.c - s.c) <= 4 AND t.vec_id <> s.vec_id),
k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY sim DESC) AS k FROM p),
"""


@query(_PROP + "x AS (SELECT vec_id, exp(sim / 0.1) w FROM k WHERE k <= 5)\nSELECT vec_id, count(*) AS n, round(max(w) / sum(w), 6) AS top_share FROM x GROUP BY vec_id")
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2, JOI11, SCL23: ties at the k-th affinity stay, the rest is renormalised."""
    k = _affinities(spark, sf_dir).where("k <= 5").withColumn("w", F.exp(F.col("sim") / 0.1))
    return k.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.max("w") / F.sum("w"), 6).alias("top_share"))


@query(_PROP + """x AS (SELECT vec_id, label, sum(exp(sim / 0.1)) w FROM k WHERE k <= 5 GROUP BY 1, 2),
s AS (SELECT vec_id, label, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS share FROM x)
SELECT vec_id, CAST(label AS INTEGER) AS label, share FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, label) n FROM s) WHERE n = 1""")
def label_propagation_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3, SRT6: weighted votes of the neighbourhood, the first of the greatest."""
    k = _affinities(spark, sf_dir).where("k <= 5")
    votes = k.groupBy("vec_id", "label").agg(F.sum(F.exp(F.col("sim") / 0.1)).alias("w"))
    share = votes.withColumn("share", F.round(F.col("w") / F.sum("w").over(W.partitionBy("vec_id")), 6))
    best = share.groupBy("vec_id").agg(F.min(F.struct((-F.col("share")).alias("s"), "label")).alias("b"))
    return best.select("vec_id", F.col("b.label").alias("label"), (-F.col("b.s")).alias("share"))


def _affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = norm(F.col("v"))
    g = vectors(spark, sf_dir).select("vec_id", "label", F.lit(0).alias("image"), (F.col("vec_id") % 25).alias("r"), F.floor(F.col("vec_id") / 25).alias("c"), F.transform("v", lambda x: x / n).alias("v"))
    pairs = G.band_join(g.drop("label"), g.withColumnRenamed("vec_id", "id"), 4, "image").where("vec_id <> id2")
    sims = pairs.select("vec_id", F.col("label2").alias("label"), F.round(dot(F.col("v"), F.col("v2")), 9).alias("sim"))
    return sims.withColumn("k", F.rank().over(W.partitionBy("vec_id").orderBy(F.desc("sim"))))


@query("""SELECT a.conv_id, a.turn, count(*) AS n_context, CAST(min(b.turn) AS BIGINT) AS oldest FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id
AND b.turn < a.turn AND (b.turn = 0 OR b.turn >= a.turn - 3) GROUP BY 1, 2""")
def fifo_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: the first frame and the last three before a frame; frame 0 never enters the queue."""
    by = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    queue = F.count(F.when(F.col("turn") > 0, 1)).over(by.rangeBetween(-3, -1))
    first = F.count(F.when(F.col("turn") == 0, 1)).over(by.rangeBetween(W.unboundedPreceding, -1))
    oldest = F.coalesce(F.min(F.when(F.col("turn") == 0, F.col("turn"))).over(by.rangeBetween(W.unboundedPreceding, -1)), F.min(F.when(F.col("turn") > 0, F.col("turn"))).over(by.rangeBetween(-3, -1)))
    return c.select("conv_id", "turn", (queue + first).alias("n_context"), oldest.alias("oldest")).where("n_context > 0")


@query("""WITH RECURSIVE s AS MATERIALIZED (SELECT user_id, value x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i FROM events),
f AS (SELECT user_id, i, x AS a FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, f.a + (s.x - f.a) * (1 - 0.9) FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, round(arg_max(a, i), 6) AS ema FROM f GROUP BY user_id""")
def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: an ordered fold per user."""
    return V.ema(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.9, bucket=F.floor(F.col("event_id") / 65536)).select("user_id", F.round("ema", 6).alias("ema"))


_PRED = "CAST(vec_id * 7 % 10 AS INTEGER)"


@query(f"""WITH r AS (SELECT label t, CASE WHEN vec_id % 3 = 0 THEN {_PRED} ELSE label END p FROM embeddings),
i AS (SELECT c, sum(CASE WHEN t = c AND p = c THEN 1 ELSE 0 END) / sum(CASE WHEN t = c OR p = c THEN 1 ELSE 0 END) iou FROM r, range(10) x(c) WHERE t = c OR p = c GROUP BY c)
SELECT round((SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) FROM r), 9) AS accuracy, round(avg(iou), 9) AS mean_iou FROM i""")
def confusion_accuracy_miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3, AGG4: micro accuracy and macro IoU from one confusion table."""
    pred = F.when(F.col("vec_id") % 3 == 0, (F.col("vec_id") * 7 % 10).cast("int")).otherwise(F.col("label"))
    counts = M.confusion(table(spark, sf_dir, "embeddings").withColumn("pred", pred), "label", "pred")
    right = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")
    acc = counts.agg(F.round(right, 9).alias("accuracy"))
    return acc.crossJoin(M.class_iou(counts).agg(F.round(F.avg("iou"), 9).alias("mean_iou")))


@query("""SELECT CAST(vec_id % 7 AS BIGINT) AS frame, round(CASE WHEN sum(CASE WHEN t OR p THEN 1 ELSE 0 END) = 0 THEN 1 ELSE sum(CASE WHEN t AND p THEN 1 ELSE 0 END) / sum(CASE WHEN t OR p THEN 1 ELSE 0 END) END, 9) AS j
FROM (SELECT vec_id, label = 3 AS t, (label = 3 OR vec_id % 11 = 0) AND vec_id % 7 <> 5 AS p FROM embeddings WHERE label <> 8) GROUP BY 1""")
def region_j(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5, FLT5: J per frame without void pixels."""
    t, v = F.col("label") == 3, F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select((v % 7).alias("frame"), t.alias("truth"), ((t | (v % 11 == 0)) & (v % 7 != 5)).alias("pred"), (F.col("label") == 8).alias("void"))
    return M.region_j(rows, ["frame"], void="void").select("frame", F.round("j", 9).alias("j"))


_EDGE = """{1} AS (SELECT image, r, c, m, coalesce(CASE WHEN r = 24 AND c = 19 THEN false WHEN r = 24 THEN m <> lead(m) OVER x WHEN c = 19 THEN m <> lead(m) OVER y
 ELSE coalesce(m <> lead(m) OVER x, false) OR coalesce(m <> lead(m) OVER y, false) OR coalesce(m <> lead(m) OVER z, false) END, false) AS edge FROM {0}
 WINDOW x AS (PARTITION BY image, r ORDER BY c), y AS (PARTITION BY image, c ORDER BY r), z AS (PARTITION BY image, c - r ORDER BY r))"""


@query(_PLANE + ", t AS (SELECT image, r, c, label < 3 AS m FROM g), p AS (SELECT image, r, c, label < 4 AS m FROM g), " + _EDGE.format("t", "e") + ", " + _EDGE.format("p", "f") + """,
a AS (SELECT * FROM e WHERE edge), b AS (SELECT * FROM f WHERE edge), i AS (SELECT DISTINCT image FROM g),
pp AS (SELECT image, avg(CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.image = b.image AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 1) THEN 1.0 ELSE 0.0 END) AS precision FROM b GROUP BY image),
rr AS (SELECT image, avg(CASE WHEN EXISTS (SELECT 1 FROM b WHERE a.image = b.image AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 1) THEN 1.0 ELSE 0.0 END) AS recall FROM a GROUP BY image),
q AS (SELECT i.image, CASE WHEN pp.image IS NULL THEN 1.0 WHEN rr.image IS NULL THEN 0.0 ELSE precision END AS precision, CASE WHEN rr.image IS NULL THEN 1.0 WHEN pp.image IS NULL THEN 0.0 ELSE recall END AS recall
 FROM i LEFT JOIN pp ON pp.image = i.image LEFT JOIN rr ON rr.image = i.image)
SELECT image, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f FROM q""")
def boundary_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6, IMG6, IMG7, WIN4: boundary precision and recall of each image, at a distance that follows from its size."""
    pixels = plane(spark, sf_dir).select("image", "r", "c", (F.col("label") < 3).alias("truth"), (F.col("label") < 4).alias("pred"))
    return M.boundary_f(pixels, 25, 20).select("image", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")])


_STATS = """WITH s AS (SELECT user_id, event_id, value / 100 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) n FROM events),
q AS (SELECT user_id, avg(x) m, avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END) r,
 avg(CASE WHEN i BETWEEN 4 // 8 AND (2 * (n - 1) + 4) // 8 % 256 THEN x END) - avg(CASE WHEN i BETWEEN (6 * (n - 1) + 4) // 8 % 256 AND (8 * (n - 1) + 4) // 8 % 256 THEN x END) d FROM s GROUP BY user_id)
"""


@query(_STATS + "SELECT user_id, round(m, 6) AS mean, round(r, 6) AS recall, round(d, 6) AS decay FROM q")
def sequence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7, with each user's events as frames."""
    s = _statistics(spark, sf_dir)
    return s.select("user_id", *[F.round(c, 6).alias(c) for c in ("mean", "recall", "decay")])


@query(_STATS + "SELECT round(avg(m), 6) AS mean, round(avg(r), 6) AS recall, round(avg(d), 6) AS decay, count(*) AS n FROM q")
def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: macro means over sequences."""
    return _statistics(spark, sf_dir).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("mean", "recall", "decay")], F.count("*").alias("n"))


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 100).alias("x"))
    return M.sequence_statistics(e, ["user_id"], "event_id", "x")


@query("""WITH s AS (SELECT CAST(label AS INTEGER) g, CAST(vec_id % 3 AS INTEGER) o, CAST(vec_id // 3 % 3 AS INTEGER) p, avg(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 9)) + 1 AS x FROM embeddings GROUP BY 1, 2, 3),
f AS (SELECT g.g, o.o, p.p, coalesce(s.x, 0) x FROM (SELECT DISTINCT g FROM s) g CROSS JOIN (SELECT i o FROM range(3) t(i)) o CROSS JOIN (SELECT i p FROM range(3) t(i)) p LEFT JOIN s ON s.g = g.g AND s.o = o.o AND s.p = p.p)
SELECT a.g AS label, round(max(a.x + b.x + c.x), 6) AS total FROM f a JOIN f b ON a.g = b.g AND b.o = 1 AND b.p <> a.p JOIN f c ON a.g = c.g AND c.o = 2 AND c.p <> a.p AND c.p <> b.p WHERE a.o = 0 GROUP BY a.g""")
def optimal_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI8, JOI9: the greatest total of one-to-one matches; the oracle tries all permutations."""
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3).cast("int").alias("o"), (F.floor(F.col("vec_id") / 3) % 3).cast("int").alias("p"), mean_of("embedding").alias("x"))
    s = e.groupBy("label", "o", "p").agg((F.avg("x") + 1).alias("x"))
    return M.optimal_assignment(s, "label", "o", "p", "x").groupBy("label").agg(F.round(F.sum("x"), 6).alias("total"))


_FRAMES = _PLANE + """, x AS (SELECT image, r AS frame, label % 4 AS t, (label * 3 + vec_id % 2) % 4 AS p FROM g),
k AS (SELECT image, frame, o, q, sum(CASE WHEN t = o AND p = q THEN 1 ELSE 0 END) AS i, sum(CASE WHEN t = o OR p = q THEN 1 ELSE 0 END) AS u FROM x, range(1, 4) a(o), range(1, 4) b(q) GROUP BY 1, 2, 3, 4),
s AS (SELECT image, o, q, avg(CASE WHEN u = 0 THEN 1.0 ELSE i / u END) AS j FROM k GROUP BY 1, 2, 3)
"""


@query(_FRAMES + "SELECT a.image, round(max(a.j + b.j + c.j), 6) AS total FROM s a JOIN s b ON a.image = b.image AND b.o = 2 AND b.q <> a.q JOIN s c ON c.image = a.image AND c.o = 3 AND c.q NOT IN (a.q, b.q) WHERE a.o = 1 GROUP BY a.image")
def unsupervised_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI8, JOI9: J of every proposal and object in every frame, averaged, and the best one-to-one matches; the oracle tries all permutations."""
    x = plane(spark, sf_dir).select("image", F.col("r").alias("frame"), (F.col("label") % 4).cast("int").alias("t"), ((F.col("label") * 3 + F.col("vec_id") % 2) % 4).cast("int").alias("p"))
    scores = M.proposal_scores(x, "image", "frame", "t", "p", 3, 3)
    return M.optimal_assignment(scores, "image", "object", "proposal", "j").groupBy("image").agg(F.round(F.sum("j"), 6).alias("total"))


@query(_PLANE + "\nSELECT image, r, c FROM g WHERE label = 2")
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL13: a mask to column-major runs and back."""
    m = plane(spark, sf_dir).withColumn("m", F.col("label") == 2)
    return G.decode_runs(G.run_lengths(m, 25), 25).select("image", "r", "c")


@query(_PLANE + "\nSELECT image, CAST(i AS INTEGER) AS r, CAST(j AS INTEGER) AS c, x FROM range(10) a(i), range(30) b(j) JOIN g ON g.r = i * 25 // 10 AND g.c = j * 20 // 30")
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG2."""
    return G.resize_nearest(plane(spark, sf_dir), 25, 20, 10, 30).select("image", "r", "c", "x")


_TAP = """{0} AS (SELECT i, lo, p - lo AS f FROM (SELECT i, p, floor(p) lo FROM (SELECT i, greatest((i + 0.5) * {1} / {2} - 0.5, 0.0) p FROM range({2}) t(i)))),
{0}2 AS (SELECT i, CAST(least(lo, {1} - 1) AS INTEGER) AS s, 1 - f AS w FROM {0} UNION ALL SELECT i, CAST(least(lo + 1, {1} - 1) AS INTEGER), f FROM {0})"""


@query(_PLANE + ", " + _TAP.format("u", 25, 10) + ", " + _TAP.format("v", 20, 30) + "\nSELECT image, CAST(u2.i AS INTEGER) AS r, CAST(v2.i AS INTEGER) AS c, round(sum(g.x * u2.w * v2.w), 6) AS x FROM g JOIN u2 ON g.r = u2.s JOIN v2 ON g.c = v2.s GROUP BY 1, 2, 3")
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG1: half-pixel centres, clamped edges."""
    return G.resize_bilinear(plane(spark, sf_dir), 25, 20, 10, 30).select("image", "r", "c", F.round("x", 6).alias("x"))


@query(_PLANE + ", " + _TAP.format("u", 25, 15) + ", " + _TAP.format("v", 20, 12) + """,
x AS (SELECT image, u2.i AS r, v2.i AS c, round(sum(g.x * u2.w * v2.w), 6) AS x FROM g JOIN u2 ON g.r = u2.s JOIN v2 ON g.c = v2.s GROUP BY 1, 2, 3),
y AS (SELECT image, i AS r, j AS c, label FROM range(15) a(i), range(12) b(j) JOIN g ON g.r = i * 25 // 15 AND g.c = j * 20 // 12)
SELECT image, CAST(r - 2 AS INTEGER) AS r, CAST(c AS INTEGER) AS c, x, label FROM x JOIN y USING (image, r, c) WHERE r BETWEEN 2 AND 13""")
def centre_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG10: the shorter side of images and labels resized to 12, then the square in the middle."""
    g = plane(spark, sf_dir)
    x = G.centre_square(g.select("image", "r", "c", "x"), 25, 20, 12).select("image", "r", "c", F.round("x", 6).alias("x"))
    labels = G.centre_square(g.select("image", "r", "c", "label"), 25, 20, 12, labels=True)
    return x.join(labels, ["image", "r", "c"]).select("image", "r", "c", "x", "label")


def _cubic(name: str, size: int, new: int) -> str:
    """Four taps of each output index with a = -0.75, as a table of (i, s, w)."""
    taps = (("pos - lo + 1", -1, "((-0.75 * {d} + 3.75) * {d} - 6) * {d} + 3"), ("pos - lo", 0, "(1.25 * {d} - 2.25) * {d} * {d} + 1"), ("1 - pos + lo", 1, "(1.25 * {d} - 2.25) * {d} * {d} + 1"), ("2 - pos + lo", 2, "((-0.75 * {d} + 3.75) * {d} - 6) * {d} + 3"))
    base = f"(SELECT i, pos, floor(pos) AS lo FROM (SELECT i, (i + 0.5) * {size} / {new} - 0.5 AS pos FROM range({new}) t(i)))"
    parts = " UNION ALL ".join(f"SELECT i, CAST(least(greatest(lo + {k}, 0), {size} - 1) AS INTEGER) AS s, {w.format(d='(' + d + ')')} AS w FROM {base}" for d, k, w in taps)
    return f"{name} AS ({parts})"


@query(_PLANE + ", " + _cubic("u", 25, 10) + ", " + _cubic("v", 20, 30) + "\nSELECT image, CAST(u.i AS INTEGER) AS r, CAST(v.i AS INTEGER) AS c, round(sum(g.x * u.w * v.w), 6) AS x FROM g JOIN u ON g.r = u.s JOIN v ON g.c = v.s GROUP BY 1, 2, 3")
def resize_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG1, UDF3: cubic convolution by its name in the registry of upsamplers."""
    return upsampler("bicubic")(plane(spark, sf_dir), 25, 20, 10, 30).select("image", "r", "c", F.round("x", 6).alias("x"))


@query(_PLANE + ", " + _TAP.format("u", 25, 12) + ", " + _TAP.format("v", 20, 10) + "\nSELECT image, CAST(u2.i * 10 + v2.i AS INTEGER) AS row, round(sum(g.x * u2.w * v2.w), 6) AS x FROM g JOIN u2 ON g.r = u2.s JOIN v2 ON g.c = v2.s GROUP BY 1, 2")
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG13: features resized to half the frame and flattened to numbered rows."""
    half = G.resize_bilinear(plane(spark, sf_dir), 25, 20, 25 // 2, 20 // 2)
    return half.select("image", (F.col("r") * 10 + F.col("c")).cast("int").alias("row"), F.round("x", 6).alias("x"))


_JITTER = """, y AS (SELECT i, CASE WHEN abs(i - 3) >= 25 THEN 48 - abs(i - 3) ELSE abs(i - 3) END AS r FROM range(31) t(i)), z AS (SELECT i, CASE WHEN abs(i - 2) >= 20 THEN 38 - abs(i - 2) ELSE abs(i - 2) END AS c FROM range(24) t(i)),
h AS (SELECT image, y.i AS r, z.i AS c, x FROM g JOIN y ON y.r = g.r JOIN z ON z.c = g.c),
u AS (SELECT i, p, floor(p) lo FROM (SELECT i, greatest((i + 0.5) / 1.25 - 0.5, 0.0) p FROM range(38) t(i))), v AS (SELECT i, p, floor(p) lo FROM (SELECT i, greatest((i + 0.5) / 0.75 - 0.5, 0.0) p FROM range(18) t(i))),
u2 AS (SELECT i, least(lo, 30) s, 1 - p + lo w FROM u UNION ALL SELECT i, least(lo + 1, 30), p - lo FROM u), v2 AS (SELECT i, least(lo, 23) s, 1 - p + lo w FROM v UNION ALL SELECT i, least(lo + 1, 23), p - lo FROM v)
SELECT image, CAST(u2.i AS INTEGER) AS r, CAST(v2.i AS INTEGER) AS c, round(sum(h.x * u2.w * v2.w), 6) AS x FROM h JOIN u2 ON h.r = u2.s JOIN v2 ON h.c = v2.s GROUP BY 1, 2, 3"""


@query(_PLANE + _JITTER)
def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG8: two columns and three rows of mirrored padding, then zoom by 1.25 and 0.75."""
    return G.jitter(plane(spark, sf_dir), 25, 20, 2, 3, 1.25, 0.75, 30.0).select("image", "r", "c", F.round("x", 6).alias("x"))


_LINEAR, _SCALE, _BIAS = [((k * 7) % 11 - 5) / 5 for k in range(64)], [1 + (k % 5 - 2) / 50 for k in range(36)], [(k % 7 - 3) / 50 for k in range(36)]


@query(f"""WITH g AS (SELECT CAST(vec_id // 500 AS BIGINT) image, CAST(vec_id % 25 AS INTEGER) r, CAST(vec_id // 25 % 20 AS INTEGER) c, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings),
k AS (SELECT image, p, q, v, exp(list_dot_product(v, {_LINEAR!r}::DOUBLE[]) * ({_SCALE!r}::DOUBLE[])[i * 6 + j + 1] + ({_BIAS!r}::DOUBLE[])[i * 6 + j + 1]) AS w FROM range(4) a(p), range(3) b(q), range(6) d(i), range(6) e(j) JOIN g ON g.r = p * 6 + i AND g.c = q * 7 + j),
l AS (SELECT image, p, q, w, unnest(v) x, generate_subscripts(v, 1) - 1 d FROM k)
SELECT image, CAST(p AS INTEGER) AS pr, CAST(q AS INTEGER) AS pc, CAST(d AS INTEGER) AS d, round(sum(w * x) / sum(w), 6) AS x FROM l GROUP BY 1, 2, 3, 4""")
def attention_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG5: patches of 6 x 6 averaged by softmax weights of their own vectors' scores."""
    v = plane(spark, sf_dir).select("image", "r", "c", "vec_id").join(vectors(spark, sf_dir).select("vec_id", "v"), "vec_id").drop("vec_id")
    return G.attention_downsample(v, 25, 20, 6, _LINEAR, _SCALE, _BIAS).select("image", "pr", "pc", "d", F.round("x", 6).alias("x"))


@query(_PLANE + "\nSELECT a.image, a.r, a.c, round(sum(b.x) / 25, 6) AS x FROM g a JOIN g b ON a.image = b.image AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY 1, 2, 3")
def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG3."""
    return G.box_blur(plane(spark, sf_dir)).select("image", "r", "c", F.round("x", 6).alias("x"))


@query(_PLANE + """\nSELECT image, CAST(p AS INTEGER) AS pr, CAST(q AS INTEGER) AS pc, round(avg(g.x), 6) AS x FROM range(4) a(p), range(4) b(q), range(6) d(k), range(6) e(l) JOIN g ON g.r = p * 6 + k AND g.c = q * 4 + l GROUP BY 1, 2, 3""")
def attention_downsample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG4, IMG5: patches of 6 x 6 at 4 x 4 places, averaged with equal weights."""
    u = G.unfold(plane(spark, sf_dir), 25, 20, 6, 4)
    return u.groupBy("image", "pr", "pc").agg(F.round(F.avg("x"), 6).alias("x"))


@query(_PLANE + "\nSELECT image, r - 8 AS r, c - 4 AS c, x FROM g WHERE r BETWEEN 8 AND 15 AND c BETWEEN 4 AND 11 AND r < 24 AND c < 16")
def crop_and_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT9, FLT11, IMG10: a window inside the patch-aligned part."""
    g = plane(spark, sf_dir).where((F.col("r") < F.floor(F.lit(25) / 8) * 8) & (F.col("c") < F.floor(F.lit(20) / 8) * 8))
    return g.where("r between 8 and 15 and c between 4 and 11").select("image", (F.col("r") - 8).alias("r"), (F.col("c") - 4).alias("c"), "x")


@query("""SELECT p_partkey, CAST((((i >> 0) & 1) << 7) | (((i >> 3) & 1) << 6) | (((i >> 6) & 1) << 5) AS BIGINT) AS red, CAST((((i >> 1) & 1) << 7) | (((i >> 4) & 1) << 6) | (((i >> 7) & 1) << 5) AS BIGINT) AS green,
 CAST((((i >> 2) & 1) << 7) | (((i >> 5) & 1) << 6) AS BIGINT) AS blue FROM (SELECT p_partkey, p_partkey % 256 AS i FROM part)""")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL16: bits of an index dealt to three channels in turn."""
    index = F.col("p_partkey") % 256

    def channel(k: int):
        out = F.lit(0).cast("bigint")
        for j, bit in enumerate(range(k, 8, 3)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(index, bit).bitwiseAND(1), 7 - j))
        return out

    return table(spark, sf_dir, "part").select("p_partkey", *[channel(k).alias(n) for k, n in enumerate(("red", "green", "blue"))])


_ROUNDS = 1000


def _power(k: int) -> str:
    """Component k by power rounds on the covariances, with the components before it taken out."""
    taken = "".join(f" - b{j}.l[1] * b{j}.v[i] * list_dot_product(b{j}.v, p.v)" for j in range(1, k))
    step = f"list_transform(range(1, 65), lambda i: list_dot_product(m.c[i], p.v){taken})"
    tables = "".join(f", b{j}" for j in range(1, k))
    return f"""p{k} AS (SELECT 0 AS t, list_transform(range(1, 65), lambda i: 1.0::DOUBLE + i * 0.37 % 1) AS v, 0.0::DOUBLE AS l
 UNION ALL SELECT t + 1, list_transform(y, lambda x: x / sqrt(list_dot_product(y, y))), sqrt(list_dot_product(y, y)) FROM (SELECT t, {step} AS y FROM p{k} p, m{tables} WHERE t < {_ROUNDS})),
b{k} AS MATERIALIZED (SELECT [l] AS l, v FROM p{k} WHERE t = {_ROUNDS})"""


@query("WITH RECURSIVE " + _LONG.removeprefix("WITH ") + """a AS (SELECT d, avg(x) AS m FROM l GROUP BY d),
z AS MATERIALIZED (SELECT vec_id, list(x - a.m ORDER BY l.d) AS v FROM l JOIN a ON a.d = l.d GROUP BY vec_id),
c AS (SELECT i, list(s ORDER BY j) AS r FROM (SELECT i, j, avg(v[i] * v[j]) AS s FROM z, range(1, 65) x(i), range(1, 65) y(j) GROUP BY i, j) GROUP BY i),
m AS MATERIALIZED (SELECT list(r ORDER BY i) AS c, count(*) AS d FROM c),
""" + ",\n".join(_power(k) for k in (1, 2, 3)) + "\nSELECT CAST(k AS INTEGER) AS component, round(l[1], 7) AS variance FROM (SELECT 1 AS k, l FROM b1 UNION ALL SELECT 2, l FROM b2 UNION ALL SELECT 3, l FROM b3)")
def low_rank_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL24: the variances along the first three components, found without a d x d matrix, measured again over all projected rows."""
    e = vectors(spark, sf_dir)
    fit = LR.low_rank_components(e, "v", 3)
    long = LR.project(e.select("v"), "v", fit).select(F.posexplode("projected").alias("i", "x"))
    return long.groupBy((F.col("i") + 1).cast("int").alias("component")).agg(F.round(F.var_pop("x"), 7).alias("variance"))
