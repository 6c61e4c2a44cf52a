"""Adapter views: the given tables seen as frames, detections, tensors, marks and payloads.

Every view exists twice, as a Spark DataFrame and as DuckDB SQL with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightlake.constants import HEAD_CLASS_COUNTS, STAGES
from sightlake.skew import HotKeys, find_hot_keys, group_row_number

NTP = 2_208_988_800_000_000_000
HOT_LIMIT = 20_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("us", F.expr("unix_micros(CAST(ts AS TIMESTAMP))"))


def frm(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).selectExpr(
        "CAST(event_id % 4 AS INT) AS stream_id", "event_id AS frame", "us * 1000 AS unix_ns",
        f"CASE event_id % 5 WHEN 0 THEN us * 1000 + {NTP} WHEN 1 THEN 0 END AS ntp_raw",
        "CASE WHEN event_id % 5 IN (0, 1) THEN us * 1000 END AS ref_raw",
        "CASE WHEN event_id % 5 = 2 THEN (event_id - 2) * 33333333 END AS buf_pts",
        "CASE WHEN event_id % 5 = 4 THEN -1 ELSE event_id * 33333333 END AS pts",
        "CASE WHEN event_id % 20 = 4 THEN event_id * 1000 ELSE -1 END AS dts",
        "CASE WHEN event_id % 5 <> 4 THEN event_id * 33333333 WHEN event_id % 20 = 4 THEN event_id * 1000 END AS buf_key",
        "CASE event_id % 7 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN 'bad' END AS explicit_id",
        "CASE WHEN event_id % 4 < 2 THEN 1920 ELSE 1280 END AS src_w",
        "CASE WHEN event_id % 4 < 2 THEN 1080 ELSE 720 END AS src_h",
        "640 AS img_w", "368 AS img_h", "event_id AS arrival_seq",
    )


FRM = """frm AS (SELECT CAST(event_id % 4 AS INT) AS stream_id, event_id AS frame,
  epoch_us(ts) * 1000 AS unix_ns,
  CASE event_id % 5 WHEN 0 THEN epoch_us(ts) * 1000 + 2208988800000000000 WHEN 1 THEN 0 END AS ntp_raw,
  CASE WHEN event_id % 5 IN (0, 1) THEN epoch_us(ts) * 1000 END AS ref_raw,
  CASE WHEN event_id % 5 = 2 THEN (event_id - 2) * 33333333 END AS buf_pts,
  CASE WHEN event_id % 5 = 4 THEN -1 ELSE event_id * 33333333 END AS pts,
  CASE WHEN event_id % 20 = 4 THEN event_id * 1000 ELSE -1 END AS dts,
  CASE WHEN event_id % 5 <> 4 THEN event_id * 33333333
       WHEN event_id % 20 = 4 THEN event_id * 1000 END AS buf_key,
  CASE event_id % 7 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'bad' END AS explicit_id,
  CASE WHEN event_id % 4 < 2 THEN 1920 ELSE 1280 END AS src_w,
  CASE WHEN event_id % 4 < 2 THEN 1080 ELSE 720 END AS src_h,
  640 AS img_w, 368 AS img_h, event_id AS arrival_seq FROM events)"""


def hot_frames(spark: SparkSession, sf: str) -> HotKeys:
    """Oversized frames of the detections."""
    orders = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"))
    return find_hot_keys(orders, ["frame"], limit=HOT_LIMIT)


def det(spark: SparkSession, sf: str, hot: HotKeys | None = None) -> DataFrame:
    c = F.col
    boxes = table(spark, sf, "lineitem").selectExpr(
        "CAST(l_orderkey % 4 AS INT) AS stream_id", "l_orderkey AS frame",
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "CAST(l_suppkey % 3 AS INT) AS class_id",
        "CAST((l_partkey % 4) * 60 AS DOUBLE) AS left", "CAST((l_suppkey % 3) * 50 AS DOUBLE) AS top",
        "l_quantity * 4 AS width", "l_quantity * 2 + l_linenumber * 6 AS height",
        "CAST(9 * round(l_discount * 100) + round(l_tax * 100) AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence",
    )
    order = [c("l_linenumber"), c("l_partkey"), c("l_suppkey"), c("l_extendedprice")]
    placed = group_row_number(boxes, ["frame"], order, "_rn", hot or hot_frames(spark, sf))
    return placed.select(
        "stream_id", "frame", (c("_rn") - 1).cast("int").alias("det_order"), "class_id", "left", "top",
        "width", "height", "confidence",
    )


DET = """det AS (SELECT CAST(l_orderkey % 4 AS INT) AS stream_id, l_orderkey AS frame,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS det_order,
  CAST(l_suppkey % 3 AS INT) AS class_id,
  CAST((l_partkey % 4) * 60 AS DOUBLE) AS "left", CAST((l_suppkey % 3) * 50 AS DOUBLE) AS top,
  l_quantity * 4 AS width, l_quantity * 2 + l_linenumber * 6 AS height,
  CAST(9 * round(l_discount * 100) + round(l_tax * 100) AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM lineitem)"""


def _head_slices() -> str:
    layers, start = [], 1
    for index, (head, n) in enumerate(HEAD_CLASS_COUNTS.items()):
        logits = f"CAST(slice(embedding, {start}, {n}) AS ARRAY<DOUBLE>)"
        layers.append(f"named_struct('layer_index', {index}, 'name', '{head}', 'logits', {logits})")
        start += n
    return f"array({', '.join(layers)})"


def logit(spark: SparkSession, sf: str) -> DataFrame:
    layers = table(spark, sf, "embeddings").selectExpr(
        "vec_id", "CAST((vec_id div 3) % 4 AS INT) AS stream_id", "vec_id div 3 AS frame",
        "CAST(vec_id % 3 AS INT) AS object_id", f"inline({_head_slices()})",
    )
    return layers.selectExpr(
        "vec_id", "stream_id", "frame", "object_id", "layer_index", "logits",
        "CASE WHEN vec_id % 4 = 3 THEN 'out_' || layer_index ELSE name END AS layer_name",
    )


LOGIT = """h(i, off, n, name) AS (VALUES (0,0,2,'severe_hemorrhage'),(1,2,2,'respiratory_distress'),(2,4,2,'trauma_head'),
  (3,6,2,'trauma_torso'),(4,8,3,'trauma_upper_ext'),(5,11,3,'trauma_lower_ext'),(6,14,3,'alertness_ocular'),(7,17,2,'person_type')),
logit AS (SELECT vec_id, CAST((vec_id // 3) % 4 AS INT) AS stream_id, vec_id // 3 AS frame, CAST(vec_id % 3 AS INT) AS object_id,
  CAST(i AS INT) AS layer_index, CASE WHEN vec_id % 4 = 3 THEN 'out_' || i ELSE name END AS layer_name,
  CAST(list_slice(embedding, off + 1, off + n) AS DOUBLE[]) AS logits FROM embeddings CROSS JOIN h)"""

# predictions per object and head in SQL, on top of LOGIT
PRED = """named AS (SELECT l.*, COALESCE(a.name, b.name) AS head, COALESCE(a.n, b.n) AS classes FROM logit l
  LEFT JOIN h a ON l.layer_name = a.name LEFT JOIN h b ON l.layer_index = b.i),
picked AS (SELECT stream_id, frame, object_id, head, arg_max(list_slice(logits, 1, classes), layer_index) AS lg
  FROM named WHERE head IS NOT NULL AND len(logits) > 0 GROUP BY ALL),
expd AS (SELECT *, list_transform(lg, lambda x: exp(x - list_max(lg))) AS ex FROM picked),
probs AS (SELECT stream_id, frame, object_id, head, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM expd),
pred AS (SELECT stream_id, frame, object_id, head, CAST(list_position(p, list_max(p)) - 1 AS INT) AS class_id,
  list_max(p) AS confidence, p AS probabilities FROM probs)"""


def mrk(spark: SparkSession, sf: str) -> DataFrame:
    offsets = {
        "mux": "0", "infer": "4000 + (event_id % 7) * 100", "assessment": "12000 + (event_id % 11) * 50",
        "convert": "13000", "osd": "13300", "sink": "13500 + (event_id % 3) * 10",
    }
    marks = ", ".join(f"named_struct('stage', '{s}', 't_us', CAST(us + {offsets[s]} AS BIGINT))" for s in STAGES)
    return _events(spark, sf).selectExpr(
        "CAST(event_id % 4 AS INT) AS stream_id", "event_id AS frame", "event_type", "event_id AS arrival_seq",
        f"inline(array({marks}))",
    ).filter(
        "NOT (stage = 'assessment' AND event_type = 'view') AND NOT (stage = 'sink' AND event_type = 'error')"
    ).drop("event_type")


MRK = """mrk AS (SELECT CAST(event_id % 4 AS INT) AS stream_id, event_id AS frame, stage, epoch_us(ts) + CASE stage
    WHEN 'mux' THEN 0 WHEN 'infer' THEN 4000 + (event_id % 7) * 100
    WHEN 'assessment' THEN 12000 + (event_id % 11) * 50 WHEN 'convert' THEN 13000
    WHEN 'osd' THEN 13300 ELSE 13500 + (event_id % 3) * 10 END AS t_us, event_id AS arrival_seq
  FROM events CROSS JOIN (VALUES ('mux'),('infer'),('assessment'),('convert'),('osd'),('sink')) AS s(stage)
  WHERE NOT (stage = 'assessment' AND event_type = 'view') AND NOT (stage = 'sink' AND event_type = 'error')),
wide AS (SELECT stream_id, frame, max(t_us) FILTER (stage = 'mux') AS mux, max(t_us) FILTER (stage = 'infer') AS infer,
  max(t_us) FILTER (stage = 'assessment') AS assessment, max(t_us) FILTER (stage = 'convert') AS "convert",
  max(t_us) FILTER (stage = 'osd') AS osd, max(t_us) FILTER (stage = 'sink') AS sink FROM mrk GROUP BY ALL)"""


def pay(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_id % 10 <> 3").selectExpr(
        "CAST(event_id % 4 AS INT) AS stream_id",
        "CASE WHEN event_id % 5 <> 4 THEN event_id * 33333333 WHEN event_id % 20 = 4 THEN event_id * 1000 END AS buf_key",
        "CAST(length(props) * 100 + event_id % 13 AS BIGINT) AS n_bytes", "event_id AS arrival_seq",
    )


PAY = """pay AS (SELECT CAST(event_id % 4 AS INT) AS stream_id,
  CASE WHEN event_id % 5 <> 4 THEN event_id * 33333333 WHEN event_id % 20 = 4 THEN event_id * 1000 END AS buf_key,
  CAST(length(props) * 100 + event_id % 13 AS BIGINT) AS n_bytes, event_id AS arrival_seq
FROM events WHERE event_id % 10 <> 3)"""


def arr(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).selectExpr(
        "CAST((event_id div 2) % 4 AS INT) AS stream_id", "event_id div 2 AS frame", "event_id AS arrival_seq",
        "us - CASE WHEN event_id % 50 = 0 THEN 7200000000 ELSE 0 END AS event_us", "event_type AS source",
        "value AS val",
    )


ARR = """arr AS (SELECT CAST((event_id // 2) % 4 AS INT) AS stream_id, event_id // 2 AS frame, event_id AS arrival_seq,
  epoch_us(ts) - CASE WHEN event_id % 50 = 0 THEN 7200000000 ELSE 0 END AS event_us, event_type AS source, value AS val
FROM events)"""


def src(spark: SparkSession, sf: str) -> DataFrame:
    """Stream sources, derived from the page addresses."""
    p, host = F.col("page_id"), F.regexp_extract("url", r"^https?://([^/]*)", 1)
    path = F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1)
    kind = p % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit("rtsp://"), host, F.lit("/cam-"), p.cast("string")))
        .when(kind == 1, F.concat(F.lit("RTSPS://"), host, F.lit("/"), path))
        .when(kind == 2, F.concat(F.lit("file:///media/my%20clip/"), path))
        .when(kind == 3, F.concat(F.lit("streams/"), path))
        .when(kind == 4, F.concat(F.lit("/abs/./"), path, F.lit("/../demo file.avi")))
        .otherwise(F.col("url"))
    )
    caps = (
        F.when(p % 7 == 0, "video/x-h265, stream-format=hvc1").when(p % 7 == 1, "video/x-h264, profile=main")
        .when(p % 7 == 2, "video/HEVC").when(p % 7 == 3, "video/avc1").when(p % 7 == 4, "video/x-vp9")
        .when(p % 7 == 5, "")
    )
    return table(spark, sf, "pages").select(
        p.alias("source_id"), raw.alias("raw"),
        F.when(p % 5 == 0, 1920).when(p % 5 == 1, 1280).when(p % 5 == 2, 1080).when(p % 5 == 3, 640).otherwise(30).alias("src_w"),
        F.when(p % 5 == 0, 1080).when(p % 5 == 1, 720).when(p % 5 == 2, 1920).when(p % 5 == 3, 480).otherwise(20).alias("src_h"),
        F.when(p % 3 == 0, 1920).when(p % 3 == 1, 640).otherwise(20).alias("long_side"), caps.alias("caps"),
        F.concat(F.lit("det"), (p % 2).cast("string")).alias("stem"),
    )


SRC = r"""src AS (SELECT page_id AS source_id, CASE page_id % 6
    WHEN 0 THEN 'rtsp://' || regexp_extract(url, '^https?://([^/]*)', 1) || '/cam-' || page_id
    WHEN 1 THEN 'RTSPS://' || regexp_extract(url, '^https?://([^/]*)', 1) || '/' || regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1)
    WHEN 2 THEN 'file:///media/my%20clip/' || regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1)
    WHEN 3 THEN 'streams/' || regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1)
    WHEN 4 THEN '/abs/./' || regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) || '/../demo file.avi' ELSE url END AS raw,
  CAST(CASE page_id % 5 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 2 THEN 1080 WHEN 3 THEN 640 ELSE 30 END AS INT) AS src_w,
  CAST(CASE page_id % 5 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 1920 WHEN 3 THEN 480 ELSE 20 END AS INT) AS src_h,
  CAST(CASE page_id % 3 WHEN 0 THEN 1920 WHEN 1 THEN 640 ELSE 20 END AS INT) AS long_side,
  CASE page_id % 7 WHEN 0 THEN 'video/x-h265, stream-format=hvc1' WHEN 1 THEN 'video/x-h264, profile=main'
    WHEN 2 THEN 'video/HEVC' WHEN 3 THEN 'video/avc1' WHEN 4 THEN 'video/x-vp9' WHEN 5 THEN '' END AS caps,
  'det' || (page_id % 2) AS stem FROM pages)"""


def reg_json(spark: SparkSession, sf: str) -> DataFrame:
    """Registry entries as JSON text, derived from the parts; some lack keys, some are broken."""
    k, c = F.col("p_partkey"), F.col
    entry = F.to_json(F.struct(
        F.when(k % 4 != 1, F.when(k % 3 == 0, 1920).when(k % 3 == 1, 640).otherwise(20)).alias("requested_long_side"),
        F.when(k % 5 != 2, F.when(k % 5 == 0, 1920).when(k % 5 == 1, 1280).when(k % 5 == 3, 640).otherwise(30)).alias("source_width"),
        F.when(k % 5 != 2, F.when(k % 5 == 0, 1080).when(k % 5 == 1, 720).when(k % 5 == 3, 480).otherwise(20)).alias("source_height"),
        F.when(k % 7 != 3, (c("p_size") + 1) * 32).alias("model_width"),
        F.when(k % 7 != 3, (c("p_size") + 2) * 32).alias("model_height"),
    ))
    return table(spark, sf, "part").select(
        F.concat(F.lit("m"), F.lpad(((k * 7919) % 100003).cast("string"), 6, "0"), F.lit("_"), k.cast("string")).alias("name"),
        F.concat(F.lit("det"), (F.call_function("div", k, F.lit(3)) % 2).cast("string")).alias("stem"),
        F.when(k % 3 == 0, 1920).when(k % 3 == 1, 640).otherwise(20).alias("long_side"),
        F.when(k % 11 == 10, F.lit("{broken")).otherwise(entry).alias("json"),
    )


REG = """reg AS (SELECT 'm' || lpad(CAST((p_partkey * 7919) % 100003 AS VARCHAR), 6, '0') || '_' || p_partkey AS name,
  'det' || ((p_partkey // 3) % 2) AS stem,
  CAST(CASE p_partkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 640 ELSE 20 END AS INT) AS long_side,
  CAST(CASE WHEN p_partkey % 11 <> 10 AND p_partkey % 4 <> 1 THEN CASE p_partkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 640 ELSE 20 END END AS INT) AS requested_long_side,
  CAST(CASE WHEN p_partkey % 11 <> 10 THEN CASE p_partkey % 5 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 3 THEN 640 WHEN 4 THEN 30 END END AS INT) AS source_width,
  CAST(CASE WHEN p_partkey % 11 <> 10 THEN CASE p_partkey % 5 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 3 THEN 480 WHEN 4 THEN 20 END END AS INT) AS source_height,
  CAST(CASE WHEN p_partkey % 11 <> 10 AND p_partkey % 7 <> 3 THEN (p_size + 1) * 32 END AS INT) AS model_width,
  CAST(CASE WHEN p_partkey % 11 <> 10 AND p_partkey % 7 <> 3 THEN (p_size + 2) * 32 END AS INT) AS model_height FROM part)"""


def ckpt(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoint inventories: suppliers have ten checkpoints each, order lines are tensors."""
    c = F.col
    n = c("l_orderkey") % 28
    heads = F.array(*[F.lit(h) for h in HEAD_CLASS_COUNTS])
    block = (c("l_partkey") % 24).cast("string")
    head = F.concat(F.lit("heads."), F.get(heads, (c("l_orderkey") % 8).cast("int")))
    fixed = {
        0: "clip_model.visual.positional_embedding", 1: "clip_model.visual.conv1.weight",
        2: "clip_model.visual.proj", 3: "clip_model.positional_embedding",
        4: "clip_model.token_embedding.weight",
    }
    key = F.when(n < 12, F.concat(head, F.when(c("l_linenumber") < 4, ".weight").otherwise(".bias")))
    key = key.when(n < 16, F.concat(F.lit("clip_model.visual.transformer.resblocks."), block, F.lit(".attn.w")))
    key = key.when(n < 20, F.concat(F.lit("clip_model.transformer.resblocks."), block, F.lit(".mlp.w")))
    for i, name in fixed.items():
        key = key.when(n == 20 + i, F.lit(name))
    return table(spark, sf, "lineitem").select(
        (c("l_suppkey") * 10 + c("l_partkey") % 10).alias("ckpt"), key.otherwise(F.lit("other.weight")).alias("key"),
        (c("l_quantity").cast("int") * 16 + 1).alias("dim0"), (c("l_linenumber") * 128).cast("int").alias("dim1"),
    )


CKPT = """ckpt AS (SELECT l_suppkey * 10 + l_partkey % 10 AS ckpt, CASE
    WHEN l_orderkey % 28 < 12 THEN 'heads.' || (['severe_hemorrhage','respiratory_distress','trauma_head','trauma_torso',
      'trauma_upper_ext','trauma_lower_ext','alertness_ocular','person_type'])[l_orderkey % 8 + 1]
      || CASE WHEN l_linenumber < 4 THEN '.weight' ELSE '.bias' END
    WHEN l_orderkey % 28 < 16 THEN 'clip_model.visual.transformer.resblocks.' || (l_partkey % 24) || '.attn.w'
    WHEN l_orderkey % 28 < 20 THEN 'clip_model.transformer.resblocks.' || (l_partkey % 24) || '.mlp.w'
    WHEN l_orderkey % 28 = 20 THEN 'clip_model.visual.positional_embedding'
    WHEN l_orderkey % 28 = 21 THEN 'clip_model.visual.conv1.weight' WHEN l_orderkey % 28 = 22 THEN 'clip_model.visual.proj'
    WHEN l_orderkey % 28 = 23 THEN 'clip_model.positional_embedding'
    WHEN l_orderkey % 28 = 24 THEN 'clip_model.token_embedding.weight' ELSE 'other.weight' END AS key,
  CAST(l_quantity AS INT) * 16 + 1 AS dim0, CAST(l_linenumber * 128 AS INT) AS dim1 FROM lineitem)"""
