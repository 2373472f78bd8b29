"""Queries of record assembly, masks, proposals and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import assembly as A
from gridloom.operators import grids as G
from gridloom.operators import metrics as M
from gridloom.operators import shards as S
from gridloom.operators import streams as T
from gridloom.plans.registry import query, table
from gridloom.plans.vectors import _PLANE, plane


@query("""WITH g AS (SELECT conv_id, list(coalesce(length(text), -1) ORDER BY turn, coalesce(length(text), -1)) l FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(range(0, 8), lambda i: coalesce(l[i + 1], -1)), ',') AS lengths FROM g""")
def cap_and_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT6, SRC2, SRC19: the first 8 turns of a conversation, missing ones -1."""
    size = F.coalesce(F.length("text"), F.lit(-1))
    # Only the first eight turns are collected, however long a conversation is.
    first = table(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("n"))
    first = first.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "n"))).where("k <= 8")
    g = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("s"))
    return g.select("conv_id", F.array_join(A.cap_and_pad(F.transform("s", lambda x: x["n"]), 8), ",").alias("lengths"))


@query("""WITH c AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS position FROM conversations)
SELECT a.conv_id, CAST(a.position AS INTEGER) AS position, coalesce(b.turn, -1) AS turn FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.position = a.position AND b.role = 'assistant' WHERE a.role = 'user'""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI6: each user turn with the assistant turn of the same position."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    return A.zip_positions(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", ["turn"], "turn")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS parts, count(DISTINCT lang) = 4 AS complete FROM documents GROUP BY source")
def required_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC25, SET4: the parts seen of each stem."""
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("p"))
    return g.select("source", F.array_join("p", ",").alias("parts"), (F.size("p") == 4).alias("complete"))


@query("SELECT CAST(doc_id % 2 AS INTEGER) AS part, count(*) AS n FROM documents GROUP BY 1")
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2, SRC3: two splits as one."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).cast("int").alias("part"))
    return d.where("part = 0").unionByName(d.where("part = 1")).groupBy("part").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT conv_id, list(role ORDER BY turn, role) l FROM conversations GROUP BY conv_id)
SELECT conv_id, l[1:3] = list_slice(['user', 'assistant', 'user'], 1, len(l[1:3])) AND len(l) >= 3 AS regular FROM g""")
def prefix_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI13: whether an earlier list begins the later one."""
    # Only as many turns as the prefix has are collected.
    first = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role"))).where("k <= 3")
    g = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "role"))).alias("s"))
    return g.select("conv_id", A.is_prefix(F.array(*map(F.lit, ("user", "assistant", "user"))), F.transform("s", lambda x: x["role"])).alias("regular"))


@query("""WITH k AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) k FROM events)
SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, avg(event_id) AS mean, CAST(count_if(event_id > 0) AS BIGINT) AS positive,
 (SELECT string_agg(CAST(k.event_id AS VARCHAR), ',' ORDER BY k.k) FROM k WHERE k.event_type = e.event_type AND k.k <= 5) AS recent FROM events e GROUP BY event_type""")
def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: counts, sums and the last five completions."""
    rows = A.counters(table(spark, sf_dir, "events").select("event_type", "event_id", "ts"), "event_type", "event_id", ["ts", "event_id"])
    return rows.withColumn("recent", F.array_join("recent", ","))


@query("""WITH e AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings)
SELECT label, round(avg(ln(list_sum(list_transform(v, lambda x: exp(x)))) - v[label + 1]), 6) AS loss FROM e GROUP BY label""")
def cross_entropy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17: softmax cross entropy with all components as logits."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return e.groupBy("label").agg(F.round(F.avg(A.cross_entropy(F.col("v"), F.col("label"))), 6).alias("loss"))


@query(_PLANE + "\nSELECT image, r, c FROM g WHERE r BETWEEN 2 AND 21 AND c BETWEEN 2 AND 17")
def interior_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10: without a border of a tenth."""
    return A.interior(plane(spark, sf_dir), 25, 20, 0.1).select("image", "r", "c")


@query(_PLANE + """, t AS (SELECT CAST(i AS INTEGER) i, CAST(floor(i * 25 / 3) AS INTEGER) h0, CAST(floor((i + 1) * 25 / 3) AS INTEGER) h1, CAST(floor(i * 20 / 3) AS INTEGER) w0, CAST(floor((i + 1) * 20 / 3) AS INTEGER) w1 FROM range(3) x(i))
SELECT g.image, g.r, g.c, CAST(CASE WHEN a.i * 3 + b.i + 1 <= 7 THEN a.i * 3 + b.i + 1 ELSE 0 END AS INTEGER) AS proposal FROM g JOIN t a ON g.r >= a.h0 AND g.r < a.h1 JOIN t b ON g.c >= b.w0 AND g.c < b.w1""")
def grid_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG11: seven tiles of a grid of three by three."""
    return A.grid_proposals(plane(spark, sf_dir), 25, 20, 7).select("image", "r", "c", "proposal")


@query(_PLANE + """, p AS (SELECT image, k, row_number() OVER (PARTITION BY image ORDER BY sha256('42:' || image || ':' || k)) AS n FROM (SELECT DISTINCT image FROM g), range(1, 10) t(k))
SELECT g.image, g.r, g.c, CAST(coalesce(p.n, 0) AS INTEGER) AS label FROM g LEFT JOIN p ON p.image = g.image AND p.k = g.label""")
def permuted_truth_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG12: object labels permuted image by image."""
    return A.relabel(plane(spark, sf_dir), "image", "label", 9, 42).select("image", "r", "c", "label")


@query(_PLANE + """, f AS (SELECT image, r, c, CASE WHEN label = 9 THEN 0 ELSE label END l, label = 9 AS void FROM g), m AS (SELECT max(l) n FROM f WHERE image = 0)
SELECT image, CAST(o AS INTEGER) AS object, CAST(count_if(l = o AND NOT void) AS BIGINT) AS pixels, CAST(count_if(void) AS BIGINT) AS void FROM f, m, range(1, 11) t(o) WHERE o <= n GROUP BY 1, 2""")
def mask_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20, SRC21, FLT5, SCL26: label maps to masks by object, with void pixels."""
    frames = plane(spark, sf_dir).withColumn("label", F.when(F.col("label") == 9, 255).otherwise(F.col("label")))
    m = A.object_masks(frames, "image", "label")
    return m.groupBy("image", "object").agg(F.count_if("truth").alias("pixels"), F.count_if("void").alias("void"))


@query(_PLANE + """, f AS (SELECT image, CASE WHEN image = 0 THEN label % 4 ELSE label % 8 END l FROM g)
SELECT image, CAST(o AS INTEGER) AS object, CAST(count_if(l = o) AS BIGINT) AS pixels FROM f, range(1, 9) t(o) WHERE o <= (SELECT max(l) FROM f) GROUP BY 1, 2""")
def prediction_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: predicted masks; objects count over all frames, not the first alone."""
    frames = plane(spark, sf_dir).withColumn("label", F.when(F.col("image") == 0, F.col("label") % 4).otherwise(F.col("label") % 8).cast("int"))
    return A.object_masks(frames, "image", "label", all_frames=True).groupBy("image", "object").agg(F.count_if("truth").alias("pixels"))


@query(_PLANE + """, m AS (SELECT image, label, count(*) AS n, CAST(sum(r) AS BIGINT) AS rows FROM g GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY label) - 1 AS i FROM m)
SELECT a.image, CAST(x.i AS INTEGER) AS mask, CAST(coalesce(k.label, -1) AS INTEGER) AS id, CAST(coalesce(k.n, -1) AS BIGINT) AS pixels, CAST(coalesce(k.rows, -1) AS BIGINT) AS rows
FROM (SELECT DISTINCT image FROM g) a CROSS JOIN range(12) x(i) LEFT JOIN k ON k.image = a.image AND k.i = x.i""")
def pair_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2, SRC11: annotations as JSON with compressed run lengths, decoded, stacked in order and padded with -1 to twelve masks."""
    g = plane(spark, sf_dir)
    masks = g.select("image", "r", "c", "label").withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("m", F.col("label") == F.col("id"))
    runs = G.run_lengths(masks.withColumn("key", F.struct("image", "id")), 25, "key").where(F.size("counts") > 1)
    one = F.struct(F.col("key.id").alias("id"), F.struct(F.array(F.lit(25), F.lit(20)).alias("size"), A.compress_counts(F.col("counts")).alias("counts")).alias("segmentation"))
    text = runs.groupBy(F.col("key.image").alias("image")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("annotations"))).alias("json"))
    shape = "annotations array<struct<id int, segmentation struct<size array<int>, counts string>>>"
    parsed = text.select("image", F.from_json("json", shape)["annotations"].alias("a"))
    held = parsed.select("image", F.posexplode("a").alias("mask", "a")).select(F.struct("image", "mask", F.col("a.id").alias("id")).alias("key"), A.expand_counts(F.col("a.segmentation.counts")).alias("counts"))
    pixels = G.decode_runs(held, 25, "key").groupBy("key").agg(F.count("*").alias("pixels"), F.sum("r").alias("rows"))
    slots = parsed.select("image", F.posexplode(A.cap_and_pad(F.transform("a", lambda x: x["id"]), 12)).alias("mask", "id"))
    out = slots.join(pixels.select("key.image", "key.mask", "pixels", "rows"), ["image", "mask"], "left")
    return out.na.fill(-1, ["pixels", "rows"])


@query(_PLANE + """, m AS (SELECT image, r, c, o, label = o AS t, (vec_id * 7) % 8 = o AS p FROM g, range(1, 10) x(o))
SELECT image, CAST(o AS INTEGER) AS object, round(CASE WHEN count_if(t OR p) = 0 THEN 1.0 ELSE count_if(t AND p) / count_if(t OR p) END, 6) AS j FROM m GROUP BY 1, 2""")
def padded_truth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI7: objects without a prediction count as empty masks."""
    g = plane(spark, sf_dir).withColumn("p", F.pmod(F.col("vec_id") * 7, F.lit(8))).withColumn("object", F.explode(F.sequence(F.lit(1), F.lit(9))))
    rows = g.select("image", "object", (F.col("label") == F.col("object")).alias("truth"), (F.col("p") == F.col("object")).alias("pred"))
    return M.region_j(rows, ["image", "object"]).withColumn("j", F.round("j", 6))


@query("SELECT CAST(i AS BIGINT) AS vec_id, e.label FROM range(20) t(i), embeddings e WHERE e.vec_id = 7")
def repeated_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT8: one row for each of 20 indices."""
    return A.repeat_row(table(spark, sf_dir, "embeddings").where("vec_id = 7"), 20).select(F.col("i").cast("bigint").alias("vec_id"), "label")


@query("SELECT p_partkey, substr(p_brand, 7) AS name FROM part WHERE starts_with(p_brand, 'Brand#')")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC27: names of a prefix, without it."""
    return A.with_prefix(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name")), "name", "Brand#")


@query("""WITH c AS (SELECT i, CASE WHEN i BETWEEN 33 AND 126 OR i BETWEEN 161 AND 172 OR i >= 174 THEN i ELSE 255 + sum(CASE WHEN i BETWEEN 33 AND 126 OR i BETWEEN 161 AND 172 OR i >= 174 THEN 0 ELSE 1 END) OVER (ORDER BY i) END AS code FROM range(256) t(i)),
b AS (SELECT page_id, k, CAST('0x' || substr(h, 2 * k + 1, 2) AS INTEGER) AS byte FROM (SELECT page_id, h, unnest(range(0, len(h) // 2)) AS k FROM (SELECT page_id, hex(encode(url)) AS h FROM pages)))
SELECT page_id, count(*) AS n, CAST(sum(code * (k % 100 + 1)) AS BIGINT) AS mark FROM b JOIN c ON c.i = b.byte GROUP BY page_id""")
def byte_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL4: the bytes of every address by the reversible map to printable code points."""
    held = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.hex(F.encode("url", "UTF-8")).alias("h"))
    # Two hex digits a byte.
    pairs = F.transform(F.regexp_extract_all("h", F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    rows = held.select("page_id", F.posexplode(pairs).alias("k", "byte"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(A.byte_alphabet(F.col("byte")) * (F.col("k") % 100 + 1)).cast("bigint").alias("mark"))


@query("""SELECT l_orderkey, l_linenumber, CAST(least(pow(2, l_linenumber - 1), 30) AS DOUBLE) AS delay,
 CAST(sum(least(pow(2, l_linenumber - 1), 30)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS DOUBLE) AS waited FROM lineitem""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7: the lines of an order as attempts with doubling delays up to 30 seconds, and the time waited so far."""
    delay = F.least(F.pow(2.0, F.col("l_linenumber") - 1), F.lit(30.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", delay.alias("delay"))
    return rows.withColumn("waited", F.sum("delay").over(W.partitionBy("l_orderkey").orderBy("l_linenumber")))


@query("SELECT event_id, value FROM events WHERE event_id > 0 AND event_id % 250 = 0")
def periodic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6: every 250th step but the first."""
    return table(spark, sf_dir, "events").where("event_id > 0 and event_id % 250 = 0").select("event_id", "value")


@query(_PLANE + "\nSELECT image, r, c FROM g WHERE label = 2")
def compressed_rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL13: runs as compressed text and back to pixels."""
    runs = G.run_lengths(plane(spark, sf_dir).withColumn("m", F.col("label") == 2), 25)
    text = runs.select("image", A.compress_counts(F.col("counts")).alias("t"))
    return G.decode_runs(text.select("image", A.expand_counts(F.col("t")).alias("counts")), 25).select("image", "r", "c")


@query("""SELECT vec_id, CAST(d AS INTEGER) AS d, round((x - [0.485, 0.456, 0.406][d % 3 + 1]) / [0.229, 0.224, 0.225][d % 3 + 1], 5) AS x
FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS d, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings)""")
def channel_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL17: less the mean, by the deviation, with the components dealt to three channels in turn."""
    # Means and deviations of the three channels.
    means, deviations = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("d") % 3)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    return e.select("vec_id", "d", F.round((F.col("x") - pick(means)) / pick(deviations), 5).alias("x"))


@query("""WITH o AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS ordinal FROM pages)
SELECT page_id, CAST(ordinal AS BIGINT) AS ordinal FROM o WHERE ordinal BETWEEN 10 AND 29""")
def preview_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC26, SRC28, SRT1, SRT7: twenty records from the tenth on (a preview; sorted take, no global window)."""
    first = table(spark, sf_dir, "pages").select("page_id").orderBy("page_id").limit(30)
    rows = S.ordinals(first.withColumn("shard", F.lit(0)), "shard", ["page_id"], 1 << 30)
    return rows.where("ordinal between 10 and 29").select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"))


_SIZE, _SEED = 10, 42


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT page_id % 4 AS consumer, page_id, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) - 1 AS i FROM pages),
s AS (SELECT consumer, CAST(-1 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS page_id FROM (SELECT DISTINCT consumer FROM o)
 UNION ALL SELECT s.consumer, o.i,
  CASE WHEN o.i < {_SIZE} THEN list_append(s.held, o.page_id) ELSE list_concat(s.held[:k], [o.page_id], s.held[k + 2:]) END,
  CASE WHEN o.i < {_SIZE} THEN NULL ELSE s.held[k + 1] END
  FROM s JOIN (SELECT *, CAST(CAST('0x' || substr(md5('{_SEED}:' || consumer || ':' || i), 1, 8) AS BIGINT) % {_SIZE} AS INTEGER) AS k FROM o) o ON o.consumer = s.consumer AND o.i = s.i + 1),
e AS (SELECT consumer, i - {_SIZE} AS position, page_id FROM s WHERE page_id IS NOT NULL),
n AS (SELECT consumer, count(*) AS n FROM o GROUP BY consumer),
r AS (SELECT consumer, unnest(held) AS page_id, generate_subscripts(held, 1) - 1 AS j FROM s JOIN n USING (consumer) WHERE s.i = n.n - 1)
SELECT consumer, CAST(position AS BIGINT) AS position, page_id FROM e
UNION ALL SELECT r.consumer, CAST(greatest(n.n - {_SIZE}, 0) + row_number() OVER (PARTITION BY r.consumer ORDER BY md5('{_SEED}:' || r.consumer || ':rest:' || j), j) - 1 AS BIGINT), page_id FROM r JOIN n USING (consumer)""")
def buffered_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT4: pages of four consumers in the order in which a buffer of ten gives them up: a random slot each time, the rest at the end."""
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("consumer"), "page_id")
    return T.reservoir_shuffle(rows, "consumer", ["page_id"], _SIZE, _SEED).select("consumer", "position", "page_id")


@query("""WITH s AS (SELECT label, CAST(count(*) AS DOUBLE) n, CAST(sum(vec_id) AS DOUBLE) / 8 AS x FROM embeddings GROUP BY label)
SELECT label, 'rows' AS measure, printf('rows: %.6f', n) AS line FROM s UNION ALL SELECT label, 'eighths', printf('eighths: %.6f', x) FROM s""")
def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: measures as lines of text with six digits."""
    s = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("rows"), (F.sum("vec_id") / 8).alias("eighths"))
    return T.score_lines(s, ["label"])
