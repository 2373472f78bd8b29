"""Queries of text functions, shard sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import repair as RP
from gridloom.functions import text as X
from gridloom.plans.registry import query, table
from gridloom.sources.wordpiece import byte_of, decode_words, encode_words


#: The references that the tables hold, with the characters; an ampersand comes last and by way of a mark, so that a pass is one pass.
_HELD = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "\x01"), ("&amp", "\x01"), ("\x01", "&"))


def _normal(column: str) -> str:
    sql = column
    for _ in range(2):
        for name, value in _HELD:
            sql = f"replace({sql}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return f"lower(trim(regexp_replace({sql}, '\\s+', ' ', 'g')))"


@query(f"SELECT page_id, {_normal('html')} AS text FROM pages")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL1."""
    return table(spark, sf_dir, "pages").select("page_id", X.normalise(F.col("html")).alias("text"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all({_normal('text')}, '''s|''t|''re|''ve|''m|''ll|''d|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def pretokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL2 over all documents."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.pretokens(X.normalise(F.col("text")))).cast("bigint").alias("n"))


@query("SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(replace(text, 'the', '[redacted]'), 'https?://\\S+', '[URL redacted]', 'g'), '\\s+', ' ', 'g')), 1, 500) AS text FROM conversations")
def redacted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL12."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.redact(F.col("text"), ["the"]).alias("text"))


def _encoded(name: str, key: str) -> str:
    """SQL of ``ids`` (key, ids) by the vocabulary's file: a word is a string of marked symbols, and a round joins its pair of the lowest rank everywhere."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    letters = {b: c for c, b in byte_of().items()}
    table = ", ".join("'" + letters[b].replace("'", "''") + "'" for b in range(256))
    return rf"""WITH RECURSIVE f AS MATERIALIZED (SELECT content AS j FROM read_text('{path}')),
g AS MATERIALIZED (SELECT k AS rank, m[1] AS a, m[2] AS b FROM (SELECT unnest(l) AS m, generate_subscripts(l, 1) AS k FROM (SELECT CAST(json_extract(j, '$.model.merges') AS VARCHAR[][]) AS l FROM f))),
v AS MATERIALIZED (SELECT e.key AS s, e.value AS id FROM (SELECT unnest(map_entries(CAST(json_extract(j, '$.model.vocab') AS MAP(VARCHAR, INTEGER)))) AS e FROM f)),
t AS MATERIALIZED (SELECT [{table}] AS l),
p AS MATERIALIZED (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS place FROM (SELECT {key}, regexp_extract_all({_normal("text")}, '''s|''t|''re|''ve|''m|''ll|''d|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+') AS l FROM {name})),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM p)),
m AS (SELECT w, chr(1) || array_to_string(list_transform(range(0, len(x) // 2), lambda i: t.l[CAST('0x' || substr(x, 2 * i + 1, 2) AS INTEGER) + 1]), chr(2) || chr(1)) || '</w>' || chr(2) AS s FROM x, t
 UNION ALL SELECT w, replace(s, chr(1) || o.a || chr(2) || chr(1) || o.b || chr(2), chr(1) || o.a || o.b || chr(2)) FROM (
  SELECT w, s, arg_min(struct_pack(a := g.a, b := g.b), rank) AS o FROM (
   SELECT w, s, unnest(list_zip(l[:-2], l[2:]), recursive := false) AS q FROM (SELECT w, s, string_split(substr(s, 2, len(s) - 2), chr(2) || chr(1)) AS l FROM m)) JOIN g ON g.a = q[1] AND g.b = q[2] GROUP BY w, s)),
e AS (SELECT w, arg_min(s, len(s)) AS s FROM m GROUP BY w),
i AS MATERIALIZED (SELECT w, list(v.id ORDER BY k) AS ids FROM (SELECT w, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT w, string_split(substr(s, 2, len(s) - 2), chr(2) || chr(1)) AS l FROM e)) JOIN v USING (s) GROUP BY w),
ids AS (SELECT n.{key}, coalesce(flatten(list(i.ids ORDER BY place) FILTER (i.ids IS NOT NULL)), []) AS ids FROM (SELECT DISTINCT {key} FROM {name}) n LEFT JOIN p ON p.{key} = n.{key} LEFT JOIN i ON i.w = p.w GROUP BY n.{key})
"""


@query(_encoded("documents", "doc_id") + "SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ',')) AS digest FROM ids")
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL3, SCL5: ids of all texts by the merges of a word-end vocabulary."""
    ids = encode_words(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ids.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join("ids", ",")).alias("digest"))


@query(_encoded("benchmark", "item_id") + """SELECT item_id, CAST(len(ids) AS INTEGER) AS n,
 array_to_string(CASE WHEN len(ids) <= 75 THEN list_concat([49406], ids, [49407], list_transform(range(0, 75 - len(ids)), lambda i: 0)) ELSE list_concat([49406], ids[:75], [49407]) END, ',') AS context FROM ids""")
def bpe_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL3, SCL5, SCL6: ids of a word-end BPE vocabulary, packed to a context of 77."""
    ids = encode_words(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return ids.select("item_id", F.size("ids").alias("n"), F.array_join(X.pack_context(F.col("ids"), 49406, 49407), ",").alias("context"))


@query(rf"SELECT item_id, array_to_string(regexp_extract_all(lower(text), '''s|''t|''re|''ve|''m|''ll|''d|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+'), ' ') AS text FROM benchmark")
def bpe_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL5, SCL3: ids of the word-end vocabulary back to text; pre-tokens come back with blanks between them."""
    return decode_words(encode_words(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id")


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def text_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL1: all texts, a third of them decoded by the wrong table once and a third twice, repaired; the clean third must stay."""
    worse = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    text, turn = F.col("text"), F.col("doc_id") % 3
    damaged = F.when(turn == 1, worse(text)).when(turn == 2, worse(worse(text))).otherwise(text)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(RP.repaired_text(damaged)).alias("digest"))
