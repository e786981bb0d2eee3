"""Queries over the scalar functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.containment import holding
from .registry import query, table


@query("scl1_hash_embedding", """
WITH toks AS (
  SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS t FROM conversations
), grams AS (
  SELECT conv_id, turn, t AS g FROM toks
  UNION ALL SELECT conv_id, turn, substr(t, i, 3) FROM (SELECT conv_id, turn, t, unnest(generate_series(1, length(t) - 2)) AS i FROM toks WHERE length(t) >= 3)
), h AS (SELECT conv_id, turn, md5(g) AS h, count(*) AS n FROM grams GROUP BY ALL),
cells AS (
  SELECT conv_id, turn, ('0x' || substr(h, 31, 2))::INT AS idx,
    sum(CASE WHEN ('0x' || substr(h, 30, 1))::INT % 2 = 1 THEN n ELSE -n END)::DOUBLE AS n FROM h GROUP BY ALL
)
SELECT conv_id, turn, idx, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM cells WHERE n <> 0
""")
def hash_embedding(spark, sf):
    vectors = S.hash_embedding(table(spark, sf, "conversations"), ["conv_id", "turn"], "text")
    return vectors.withColumn("value", F.round("value", 6))


@query("scl3_token_jaccard", """
WITH t AS (
  SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 1)) AS ts FROM conversations
), p AS (SELECT conv_id, turn, ts, lag(ts) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(ts, b))) = 0 THEN 0.0
  ELSE round(len(list_intersect(ts, b)) / len(list_distinct(list_concat(ts, b))), 6) END AS similarity
FROM p WHERE b IS NOT NULL
""")
def token_jaccard(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", S.tokens(F.col("text")).alias("ts"))
    pairs = t.withColumn("b", F.lag("ts").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return pairs.select("conv_id", "turn", F.round(S.jaccard(F.col("ts"), F.col("b")), 6).alias("similarity"))


@query("scl5_token_estimate", "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query("scl6_span_hash", """
SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS state_key FROM events
""")
def span_hash(spark, sf):
    return table(spark, sf, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("state_key"))


@query("scl7_canonical_url", "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.canonical_url(F.col("url")).alias("url"))


@query("scl8_slug", """
SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM part
""")
def slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


@query("scl10_squashed_contains", """
SELECT doc_id, item_id FROM (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r]+', '', 'g') AS s FROM documents) d,
  (SELECT item_id, regexp_replace(text, '[ \\t\\n\\r]+', '', 'g') AS k FROM benchmark) b
WHERE contains(s, k)
""")
def squashed_contains(spark, sf):
    """Whole passages that a document holds, white space ignored."""
    squashed = lambda name, key, into: table(spark, sf, name).select(key, F.regexp_replace("text", "[ \\t\\n\\r]+", "").alias(into))
    b = squashed("benchmark", "item_id", "k")
    return holding(squashed("documents", "doc_id", "s"), "doc_id", "s", b, "k").join(b, "k").select("doc_id", "item_id").distinct()


@query("scl12_json_path", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("scl13_expand", "SELECT n_nationkey, replace(replace('${name} in ${region} of ${other}', '${name}', n_name), '${region}', n_regionkey::VARCHAR) AS text FROM nation")
def expand(spark, sf):
    values = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", S.expand(F.lit("${name} in ${region} of ${other}"), values).alias("text"))


@query("scl14_path_layer", """
SELECT page_id, CASE WHEN regexp_matches(url, '/(en|fr)/') THEN 'interface' WHEN regexp_matches(url, '/(de)/') THEN 'application'
  WHEN regexp_matches(url, '/(es)/') THEN 'domain' ELSE 'infrastructure' END AS layer FROM pages
""")
def path_layer(spark, sf):
    rules = [("interface", "/(en|fr)/"), ("application", "/(de)/"), ("domain", "/(es)/")]
    return table(spark, sf, "pages").select("page_id", S.first_rule(F.col("url"), rules, "infrastructure").alias("layer"))


@query("scl16_keyword_bucket", """
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 'secret'
  WHEN contains(lower(text), 'redirect') THEN 'redirect' ELSE 'other' END AS bucket FROM conversations
""")
def keyword_bucket(spark, sf):
    classes = [("secret", ["password", "token"]), ("redirect", ["redirect"])]
    return table(spark, sf, "conversations").select("conv_id", "turn", S.first_match(F.lower("text"), classes, "other").alias("bucket"))


@query("scl18_model_tier", """
SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'deep' WHEN o_orderstatus = 'F' THEN 'light' ELSE 'standard' END AS tier FROM orders
""")
def model_tier(spark, sf):
    severity = F.concat(F.lit("P"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"))
    category = F.when(F.col("o_orderstatus") == "F", "style").otherwise("logic")
    return table(spark, sf, "orders").select("o_orderkey", S.model_tier(severity, category).alias("tier"))


@query("scl19_recent", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '2024-01-30'")
def recent(spark, sf):
    return table(spark, sf, "events").where(S.recent(F.col("ts"), "2024-01-30 00:00:00", 7)).select("event_id")


@query("scl20_duration", """
SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN format('{:.1f} s', (ms // 100) / 10.0)
  ELSE (ms // 60000) || ' min ' || ((ms % 60000) // 1000) || ' s' END AS took FROM (SELECT event_id, (event_id * 37) % 200000 AS ms FROM events)
""")
def duration(spark, sf):
    return table(spark, sf, "events").select("event_id", S.duration_text((F.col("event_id") * 37) % 200000).alias("took"))


@query("scl22_clip", """
SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(CASE WHEN regexp_matches(substr(text, 61, 1), '[A-Za-z0-9_]') AND regexp_matches(substr(text, 1, 60), '[A-Za-z0-9_]$')
   AND length(regexp_replace(substr(text, 1, 60), '[A-Za-z0-9_]+$', '')) > 0 THEN regexp_replace(substr(text, 1, 60), '[A-Za-z0-9_]+$', '') ELSE substr(text, 1, 60) END, ' ') || '…' END AS clipped FROM documents
""")
def clip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.clip(F.col("text"), 60).alias("clipped"))


@query("scl24_flatten_fields", "SELECT event_id, 'k' AS path, props->>'$.k' AS value FROM events")
def flatten_fields(spark, sf):
    return S.flatten_json(table(spark, sf, "events"), ["event_id"], "props")
