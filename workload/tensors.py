"""Queries over tensors: decoding, heads, predictions, labels and assessment messages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from sightlake.constants import DISPLAY_ROWS, HEAD_CLASS_COUNTS, HEAD_LABELS
from sightlake.functions import geometry, tensors as X, text
from sightlake.functions.tensors import ELEMENT_TYPES
from sightlake.operators import detections as D, keyed as K, predictions as P
from sightlake.operators.predictions import HeadWeights
from sightlake.plans import assess as A
from sightlake.plans.detect import timed_metadata

from . import views as V
from .frames import NUM, STAMP, TSR, TXT
from .registry import query
from .state import LAT, stage_latencies
from .views import DET, FRM, LOGIT, MRK, PRED

KEYS = ["stream_id", "frame", "object_id"]
SQL_PROBS = "round(probabilities[1], 6) AS p0, round(probabilities[2], 6) AS p1, round(probabilities[3], 6) AS p2"

_labels = ", ".join(
    f"('{h}', {n}, '{label}')" for h, labels in HEAD_LABELS.items() for n, label in labels.items()
)
LAB = f"""lab(head, class_id, label) AS (VALUES {_labels}),
labelled AS (SELECT p.*, COALESCE(label, p.head || '=class' || p.class_id) AS label FROM pred p LEFT JOIN lab USING (head, class_id))"""
_rows = ", ".join(
    "list_aggregate(list_filter([" + ", ".join(f"COALESCE(max(label) FILTER (head = '{h}'), '')" for h in row)
    + "], lambda x: x <> ''), 'string_agg', '  ')" for row in DISPLAY_ROWS
)
LINES = f"""lines AS (SELECT stream_id, frame, object_id, [('person ' || object_id || ' injuries:'), {_rows}] AS raw_lines FROM labelled GROUP BY stream_id, frame, object_id),
text_lines AS (SELECT stream_id, frame, object_id, list_filter(raw_lines, lambda x: x IS NOT NULL AND x <> '') AS lines FROM lines)"""
# assessed persons with box and lines
ASSESSED = """aobj AS (SELECT n.*, n."left" * (f.img_w / f.src_w) AS x, n.top * (f.img_h / f.src_h) AS y, n.width * (f.img_w / f.src_w) AS w,
    n.height * (f.img_h / f.src_h) AS ht, lines, CAST(row_number() OVER (PARTITION BY n.stream_id, n.frame ORDER BY n.det_order) - 1 AS INT) AS object_index
  FROM num n JOIN text_lines USING (stream_id, frame, object_id) JOIN frm f USING (stream_id, frame) WHERE n.width >= 8 AND n.height >= 8)"""
ALL = (FRM, DET, NUM, LOGIT, PRED, LAB, LINES, ASSESSED)


def probs() -> list:
    return [F.round(F.get("probabilities", i), 6).alias(f"p{i}") for i in range(3)]


def predicted(spark, sf):
    return P.predict_objects(V.logit(spark, sf))


@query("tensor_elements", """d AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS n, [CAST(p_size AS BIGINT), p_partkey % 7 + 1, 3] AS dims FROM part)""",
       sql="SELECT p_partkey, CASE WHEN n > 0 THEN CAST(n AS BIGINT) ELSE CAST(list_product(dims) AS BIGINT) END AS elements FROM d")
def tensor_elements(spark, sf):
    k = F.col("p_partkey")
    shaped = V.table(spark, sf, "part").select(
        k, F.when(k % 3 == 0, F.col("p_size")).alias("n"),
        F.array(F.col("p_size").cast("bigint"), k % 7 + 1, F.lit(3).cast("bigint")).alias("dims"),
    )
    return shaped.select("p_partkey", X.element_count("n", "dims").alias("elements"))


@F.pandas_udf(T.BinaryType())
def pack(values: pd.Series, dtype: pd.Series) -> pd.Series:
    return pd.Series([
        np.asarray(v, dtype="float64").astype(ELEMENT_TYPES.get(t, "<f8")).tobytes() for v, t in zip(values, dtype)
    ])


@query("tensor_decode", LOGIT, sql="""SELECT vec_id, layer_index, CASE WHEN vec_id % 5 = 4 THEN 'DOUBLE' WHEN vec_id % 5 = 3 THEN 'INT8' WHEN vec_id % 5 = 2 THEN 'INT32' ELSE 'FLOAT' END AS dtype,
  CASE WHEN vec_id % 5 = 4 THEN 0 ELSE len(logits) END AS n,
  CASE WHEN vec_id % 5 < 2 THEN logits[1] WHEN vec_id % 5 < 4 THEN CAST(trunc(logits[1] * 100) AS DOUBLE) END AS first_value,
  CASE WHEN vec_id % 5 < 2 THEN logits[2] WHEN vec_id % 5 < 4 THEN CAST(trunc(logits[2] * 100) AS DOUBLE) END AS second_value FROM logit""")
def tensor_decode(spark, sf):
    kind = F.col("vec_id") % 5
    dtype = F.when(kind == 4, "DOUBLE").when(kind == 3, "INT8").when(kind == 2, "INT32").otherwise("FLOAT")
    scaled = F.when(kind.isin(2, 3), F.transform("logits", lambda x: x * 100)).otherwise(F.col("logits"))
    packed = V.logit(spark, sf).withColumn("dtype", dtype).withColumn("n", F.size("logits").cast("bigint"))
    packed = packed.withColumn("buffer", pack(scaled, "dtype"))
    out = packed.withColumn("values", X.decode_tensor("buffer", "dtype", "n"))
    return out.select(
        "vec_id", "layer_index", "dtype", F.size("values").cast("bigint").alias("n"),
        F.get("values", 0).alias("first_value"), F.get("values", 1).alias("second_value"),
    )


@query("head_resolve", LOGIT, """named AS (SELECT l.*, COALESCE(a.name, b.name) AS head, COALESCE(a.n, b.n) AS n FROM logit l
  LEFT JOIN h a ON l.layer_name = a.name LEFT JOIN h b ON l.layer_index + l.vec_id % 3 = b.i)""",
       sql="SELECT vec_id, layer_index, layer_name, head, CAST(n AS INT) AS n_classes FROM named WHERE head IS NOT NULL")
def head_resolve(spark, sf):
    # positions past the last head occur and resolve to nothing
    shifted = V.logit(spark, sf).withColumns({
        "own": F.col("layer_index"), "layer_index": (F.col("layer_index") + F.col("vec_id") % 3).cast("int"),
    })
    return P.resolve_heads(shifted).select(
        "vec_id", F.col("own").alias("layer_index"), "layer_name", "head", "n_classes"
    )


@query("softmax", LOGIT, """e AS (SELECT vec_id, layer_index, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM logit)""",
       sql="""SELECT vec_id, layer_index, round(ex[1] / list_sum(ex), 6) AS p0, round(ex[2] / list_sum(ex), 6) AS p1,
  round(ex[3] / list_sum(ex), 6) AS p2 FROM e""")
def softmax(spark, sf):
    scored = V.logit(spark, sf).withColumn("probabilities", X.softmax("logits"))
    return scored.select("vec_id", "layer_index", *probs())


@query("head_predictions", LOGIT, PRED, sql=f"SELECT stream_id, frame, object_id, head, class_id, round(confidence, 6) AS confidence, {SQL_PROBS} FROM pred")
def head_predictions(spark, sf):
    return P.explode_heads(predicted(spark, sf)).select(
        *KEYS, "head", "class_id", F.round("confidence", 6).alias("confidence"), *probs()
    )


@query("injury_labels", LOGIT, PRED, LAB, sql="""SELECT stream_id, frame, object_id, head,
  CASE WHEN frame % 10 = 0 THEN head || '=class9' ELSE label END AS label FROM labelled""")
def injury_labels(spark, sf):
    exploded = P.explode_heads(predicted(spark, sf))
    shown = F.when(F.col("frame") % 10 == 0, 9).otherwise(F.col("class_id"))
    return exploded.select(*KEYS, "head", X.label_text("head", shown).alias("label"))


@query("label_lines", LOGIT, PRED, LAB, LINES, sql="""SELECT stream_id, frame, object_id, list_aggregate(lines, 'string_agg', chr(10)) AS display,
  list_aggregate(lines, 'string_agg', ' | ') AS log_label FROM text_lines""")
def label_lines(spark, sf):
    lines = text.label_lines("object_id", X.labels_of("predictions"))
    return predicted(spark, sf).withColumn("lines", lines).select(
        *KEYS, F.array_join("lines", "\n").alias("display"), text.label_log("lines").alias("log_label")
    )


@query("predictions_json", LOGIT, PRED, sql="""SELECT stream_id, frame, object_id, head, CASE WHEN frame % 4 = 0 THEN -1 ELSE class_id END AS class_id,
  CASE WHEN frame % 4 = 1 THEN 0.0::DOUBLE ELSE round(confidence, 6) END AS confidence, CASE WHEN frame % 4 = 2 THEN 0 ELSE len(probabilities) END AS n FROM pred""")
def predictions_json(spark, sf):
    """Prediction maps through JSON and back, with members missing in turn."""
    f = F.col("frame") % 4
    thin = predicted(spark, sf).withColumn("predictions", F.transform_values("predictions", lambda _, p: F.struct(
        F.when(f != 0, p["class_id"]).alias("class_id"), F.when(f != 1, p["confidence"]).alias("confidence"),
        F.when(f != 2, p["probabilities"]).alias("probabilities"),
    )))
    schema = thin.schema["predictions"].dataType
    full = thin.withColumn("json", F.to_json("predictions")).select(
        *KEYS, X.complete_predictions(F.from_json("json", schema)).alias("predictions")
    )
    return P.explode_heads(full).select(
        *KEYS, "head", "class_id", F.round("confidence", 6).alias("confidence"),
        F.size("probabilities").cast("bigint").alias("n"),
    )


@query("annotations", LOGIT, PRED, """o AS (SELECT *, CASE WHEN frame % 5 = 0 THEN [CAST(class_id AS DOUBLE), confidence] ELSE probabilities END AS obs,
    row_number() OVER (PARTITION BY stream_id, frame, object_id ORDER BY head) - 1 AS pos FROM pred)""",
       sql="""SELECT stream_id, frame, object_id, CAST(pos AS INT) AS pos, 'clip_rgb_' || head AS field_name, len(obs) AS n,
  round(obs[1], 6) AS o0, round(obs[2], 6) AS o1 FROM o""")
def annotations(spark, sf):
    bare = F.transform_values("predictions", lambda _, p: F.when(
        F.col("frame") % 5 == 0, p.withField("probabilities", F.array().cast("array<double>"))
    ).otherwise(p))
    listed = predicted(spark, sf).select(*KEYS, F.posexplode(X.annotations(bare)).alias("pos", "a"))
    return listed.select(
        *KEYS, "pos", "a.field_name", F.size("a.observation").cast("bigint").alias("n"),
        F.round(F.get("a.observation", 0), 6).alias("o0"), F.round(F.get("a.observation", 1), 6).alias("o1"),
    )


@query("overlay_text", *ALL[1:7], sql="""SELECT n.stream_id, n.frame, n.det_order, COALESCE(list_aggregate(lines, 'string_agg', chr(10)), '') AS display,
  CASE WHEN lines IS NOT NULL THEN greatest(0, CAST(round_even(n."left", 0) AS BIGINT)) END AS x_offset,
  CASE WHEN lines IS NOT NULL THEN greatest(0, CAST(round_even(n.top + n.height + 8, 0) AS BIGINT)) END AS y_offset
  FROM num n LEFT JOIN text_lines USING (stream_id, frame, object_id)""")
def overlay_text(spark, sf):
    hot = V.hot_frames(spark, sf)
    numbered = D.number_persons(D.confident(V.det(spark, sf, hot)), hot=hot)
    lines = text.label_lines("object_id", X.labels_of("predictions"))
    shown = numbered.join(predicted(spark, sf), KEYS, "left").withColumns({
        "place": geometry.assessment_text_offset(geometry.bbox()), "lines": lines,
    })
    assessed = F.col("predictions").isNotNull()
    return shown.select(
        "stream_id", "frame", "det_order",
        F.when(assessed, F.array_join("lines", "\n")).otherwise("").alias("display"),
        F.when(assessed, F.col("place.x_offset")).alias("x_offset"),
        F.when(assessed, F.col("place.y_offset")).alias("y_offset"),
    )


def assess_records(spark, sf):
    hot = V.hot_frames(spark, sf)
    return A.assess_records(
            V.frm(spark, sf), V.det(spark, sf, hot), V.logit(spark, sf), hot=hot
    )


@query("assess_frames", *ALL, sql="""SELECT stream_id, frame, count(*) AS object_count, string_agg(CAST(object_id AS VARCHAR), ',' ORDER BY det_order) AS ids
  FROM aobj GROUP BY stream_id, frame""")
def assess_frames(spark, sf):
    ids = F.transform("objects", lambda o: o["object_id"].cast("string"))
    return assess_records(spark, sf).select("stream_id", "frame", "object_count", F.array_join(ids, ",").alias("ids"))


@query("assess_objects", *ALL, sql="""SELECT a.stream_id, a.frame, object_index, a.object_id, x, y, w, ht AS h, "left" AS sx, top AS sy, width AS sw, height AS sh,
  'person' AS class_name, list_aggregate(lines, 'string_agg', '/') AS labels, head, p.class_id, round(p.confidence, 6) AS confidence
  FROM aobj a JOIN pred p USING (stream_id, frame, object_id)""")
def assess_objects(spark, sf):
    hot = V.hot_frames(spark, sf)
    o = A.assessed_persons(V.frm(spark, sf), V.det(spark, sf, hot), V.logit(spark, sf), hot=hot)
    return o.select("*", F.explode("predictions").alias("head", "p")).select(
        "stream_id", "frame", "object_index", "object_id",
        *[F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")],
        *[F.col("source_bbox")[i].alias(n) for i, n in enumerate(("sx", "sy", "sw", "sh"))],
        "class_name", F.array_join("labels", "/").alias("labels"), "head", "p.class_id",
        F.round("p.confidence", 6).alias("confidence"),
    )


@query("assess_log_rows", *ALL, sql="""SELECT stream_id, frame, object_id, 'object=' || object_id || ' bbox=' || printf('%.0f', x) || ',' || printf('%.0f', y) || ','
  || printf('%.0f', w) || ',' || printf('%.0f', ht) || ' ' || list_aggregate(lines, 'string_agg', ' | ') AS log_row FROM aobj""")
def assess_log_rows(spark, sf):
    hot = V.hot_frames(spark, sf)
    o = A.assessed_persons(V.frm(spark, sf), V.det(spark, sf, hot), V.logit(spark, sf), hot=hot)
    return o.select(*KEYS, text.assess_row("object_id", "bbox", "labels").alias("log_row"))


@query("casualty_messages", *ALL, TSR, sql=f"""SELECT t.stream_id, t.frame, a.object_id, t.frame % 2147483647 AS data_source_id, {STAMP}, a.x AS bbox_x, a.y AS bbox_y,
  a.w AS bbox_width, a.ht AS bbox_height, 'platform' AS platform_name, 'camera' AS sensor_frame_id, false AS is_sensor_frame_moving,
  'clip_rgb_' || head AS field_name, round(probabilities[1], 6) AS o0, round(probabilities[2], 6) AS o1
  FROM tsr t JOIN aobj a USING (stream_id, frame) JOIN pred p USING (stream_id, frame, object_id)""")
def casualty_messages(spark, sf):
    hot = V.hot_frames(spark, sf)
    messages = A.casualties(
            V.frm(spark, sf), V.det(spark, sf, hot), V.logit(spark, sf), hot=hot
    )
    return messages.select("*", F.inline("annotations")).select(
        *KEYS, "data_source_id", "stamp.sec", "stamp.nanosec", "bbox_x", "bbox_y", "bbox_width", "bbox_height",
        "platform_name", "sensor_frame_id", "is_sensor_frame_moving", "field_name",
        F.round(F.get("observation", 0), 6).alias("o0"), F.round(F.get("observation", 1), 6).alias("o1"),
    )


@query("fresh_frames", FRM, LOGIT, PRED, sql="""SELECT stream_id, frame, buf_key FROM frm WHERE EXISTS (
  SELECT 1 FROM pred p WHERE p.stream_id = frm.stream_id AND p.frame = frm.frame)""")
def fresh_frames(spark, sf):
    frames = V.frm(spark, sf).select("stream_id", "frame", "buf_key")
    return K.fresh_frames(frames, predicted(spark, sf))


@query("fork_outputs", *ALL, sql="""SELECT 'IMAGE' AS stage, count(*) AS frames, CAST(0 AS BIGINT) AS objects FROM frm
  UNION ALL SELECT 'DETECT', (SELECT count(*) FROM frm), (SELECT count(*) FROM num JOIN frm USING (stream_id, frame))
  UNION ALL SELECT 'ASSESS', count(DISTINCT (stream_id, frame)), count(*) FROM aobj""")
def fork_outputs(spark, sf):
    hot = V.hot_frames(spark, sf)
    branches = A.fork(V.frm(spark, sf), V.det(spark, sf, hot), V.logit(spark, sf), hot=hot)
    out = None
    for df in branches.values():
        if "objects" not in df.columns:
            df = df.withColumn("n_objects", F.lit(0).cast("bigint"))
        else:
            df = df.withColumn("n_objects", F.size("objects").cast("bigint"))
        one = df.groupBy("stage").agg(F.count("*").alias("frames"), F.sum("n_objects").alias("objects"))
        out = one if out is None else out.unionByName(one)
    return out


@query("record_all", *ALL, TSR, sql=f"""SELECT topic, stream_id, frame, sec, nanosec, n FROM (
  SELECT 'image' AS topic, stream_id, frame, {STAMP}, CAST(0 AS BIGINT) AS n FROM tsr
  UNION ALL SELECT 'target_detections', t.stream_id, t.frame, {STAMP}, (SELECT count(*) FROM num n WHERE n.stream_id = t.stream_id AND n.frame = t.frame) FROM tsr t
  UNION ALL SELECT 'casualty', t.stream_id, t.frame, {STAMP}, (SELECT count(*) FROM pred p WHERE p.stream_id = a.stream_id AND p.frame = a.frame AND p.object_id = a.object_id)
    FROM tsr t JOIN aobj a USING (stream_id, frame))""")
def record_all(spark, sf):
    hot = V.hot_frames(spark, sf)
    recorded = A.record_topics(
            V.frm(spark, sf), V.det(spark, sf, hot), V.logit(spark, sf), hot=hot
    )
    boxes = F.from_json("message", "uav_target_boxes array<struct<size_x:double>>, annotations array<struct<field_name:string>>")
    sized = recorded.withColumn("m", boxes)
    n = F.coalesce(F.size("m.uav_target_boxes"), F.size("m.annotations"), F.lit(0))
    return sized.select("topic", "stream_id", "frame", "stamp.sec", "stamp.nanosec", n.cast("bigint").alias("n"))


EMBED_WIDTH = 64


@query("channel_normalize", sql="""SELECT vec_id, CAST(pos AS INT) AS pos, round((x * 0.00392156862745098 - ([0.48145466, 0.4578275, 0.40821073]::DOUBLE[])[pos // 22 + 1])
  / ([0.26862954, 0.26130258, 0.27577711]::DOUBLE[])[pos // 22 + 1], 6) AS x FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE * 255 AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""")
def channel_normalize(spark, sf):
    pixels = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 255)
    scaled = V.table(spark, sf, "embeddings").withColumn("pixels", pixels).select(
        "vec_id", F.posexplode(X.normalize_channels("pixels", F.lit(22))).alias("pos", "x")
    )
    return scaled.withColumn("x", F.round("x", 6))


@query("l2_normalize", sql="""SELECT vec_id, CAST(pos AS INT) AS pos, round(x / greatest(norm, 1e-6), 6) AS x FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos,
    sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))) AS norm FROM embeddings)""")
def l2_normalize(spark, sf):
    unit = X.l2_normalize(F.col("embedding").cast("array<double>"))
    return V.table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("pos", "x")).withColumn(
        "x", F.round("x", 6)
    )


def head_weights() -> HeadWeights:
    """Weights by rule: row r, column j holds ((7 r + 3 j) mod 11 - 5) / 10, bias r / 10."""
    row, weights, biases = 0, {}, {}
    for head, classes in HEAD_CLASS_COUNTS.items():
        r = np.arange(row, row + classes)[:, None]
        weights[head] = ((7 * r + 3 * np.arange(EMBED_WIDTH)[None, :]) % 11 - 5) / 10
        biases[head] = r[:, 0] / 10
        row += classes
    return HeadWeights(weights, biases)


LINEAR = """w AS (SELECT r, list_transform(range(64), lambda j: ((7 * r + 3 * j) % 11 - 5) / 10.0::DOUBLE) AS row FROM range(19) t(r)),
rows_of(layer_index, first, n) AS (VALUES (0,0,2),(1,2,2),(2,4,2),(3,6,2),(4,8,3),(5,11,3),(6,14,3),(7,17,2))"""
LINEAR_SQL = """SELECT vec_id, CAST(layer_index AS INT) AS layer_index, CAST(r - first AS INT) AS class_id,
  round(list_inner_product(embedding::DOUBLE[], row) + r / 10.0::DOUBLE, 4) AS logit
  FROM embeddings CROSS JOIN w JOIN rows_of ON r >= first AND r < first + n"""


def _long(scored):
    return scored.select("vec_id", "layer_index", F.posexplode("logits").alias("class_id", "logit")).withColumn(
        "logit", F.round("logit", 4)
    )


@query("multihead_linear", LINEAR, sql=LINEAR_SQL)
def multihead_linear(spark, sf):
    return _long(P.score_heads(V.table(spark, sf, "embeddings"), "embedding", head_weights(), ["vec_id"]))


@query("predict_batch", LINEAR, sql=LINEAR_SQL)
def predict_batch(spark, sf):
    embedded = V.table(spark, sf, "embeddings")
    return _long(P.infer(embedded, "embedding", head_weights, EMBED_WIDTH, ["vec_id"]))


@query("timed_assess_metadata", *ALL, MRK, LAT, TSR, TXT, """rowtext AS (SELECT stream_id, frame, string_agg('  object=' || object_id || ' bbox=' || printf('%.0f,%.0f,%.0f,%.0f', x, y, w, ht)
    || ' ' || array_to_string(lines, ' | '), chr(10) ORDER BY det_order) AS body, count(*) AS n FROM aobj GROUP BY ALL)""",
       sql="""SELECT t.stream_id, t.frame, n AS object_count, 'ASSESS frame=' || t.frame || ' timestamp=' || ts_text || ' timestamp_source=' || source
  || COALESCE(' detect_ms=' || printf('%.2f', detect_ms), '') || COALESCE(' detect_fps=' || printf('%.2f', CASE WHEN detect_ms > 0 THEN 1000.0::DOUBLE / detect_ms END), '')
  || COALESCE(' assess_ms=' || printf('%.2f', assess_ms), '') || COALESCE(' assess_fps=' || printf('%.2f', CASE WHEN assess_ms > 0 THEN 1000.0::DOUBLE / assess_ms END), '')
  || ' source=' || src_w || 'x' || src_h || ' image=' || img_w || 'x' || img_h || chr(10) || body AS log_text
  FROM txt t JOIN rowtext USING (stream_id, frame) LEFT JOIN lat USING (stream_id, frame)""")
def timed_assess_metadata(spark, sf):
    """Assess records with labels and both stage times in their log text."""
    hot = V.hot_frames(spark, sf)
    records = A.assess_records(V.frm(spark, sf), V.det(spark, sf, hot), V.logit(spark, sf), hot=hot)
    made = timed_metadata(records, stage_latencies(spark, sf), "ASSESS")
    return made.select("stream_id", "frame", F.col("object_count").cast("bigint").alias("object_count"), "log_text")
