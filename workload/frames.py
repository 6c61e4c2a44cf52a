"""Queries over frames and detections: filters, geometry, time, records, messages, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightlake.functions import clock, geometry, identity, text
from sightlake.operators import detections as D, messages as M, records as R, suppression as S
from sightlake.operators import timing as T
from sightlake.plans import detect as P
from sightlake.skew import no_hot_keys

from . import views as V
from .registry import query
from .views import DET, FRM, MRK, PAY

KEYS = ["stream_id", "frame"]

NUM = """num AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream_id, frame ORDER BY det_order) - 1 AS INT) AS object_id
  FROM det WHERE class_id = 0 AND confidence >= 0.2)"""
TSR = """tsr AS (SELECT *,
  CASE WHEN ntp_raw > 0 THEN 'ntp' WHEN ref_raw > 0 THEN 'ref' WHEN buf_pts >= 0 THEN 'buf_pts' WHEN pts >= 0 THEN 'pts' ELSE 'none' END AS source,
  CASE WHEN ntp_raw > 0 THEN CASE WHEN ntp_raw > 2208988800000000000 THEN ntp_raw - 2208988800000000000 ELSE ntp_raw END
       WHEN ref_raw > 0 THEN CASE WHEN ref_raw > 2208988800000000000 THEN ref_raw - 2208988800000000000 ELSE ref_raw END
       WHEN buf_pts >= 0 THEN buf_pts WHEN pts >= 0 THEN pts END AS ts_ns FROM frm)"""
TXT = """txt AS (SELECT *, CASE WHEN ts_ns IS NULL THEN 'NONE'
    WHEN source IN ('ntp', 'ref') THEN strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S.%g') || 'Z'
    ELSE printf('%.3f', ts_ns / 1e9) || 's' END AS ts_text FROM tsr)"""
# scaled persons with their log row
OBJ = """obj AS (SELECT n.stream_id, n.frame, n.det_order, n.object_id, n.confidence, n."left" AS sx, n.top AS sy, n.width AS sw, n.height AS sh,
    n."left" * (f.img_w / f.src_w) AS x, n.top * (f.img_h / f.src_h) AS y, n.width * (f.img_w / f.src_w) AS w, n.height * (f.img_h / f.src_h) AS ht
  FROM num n JOIN frm f USING (stream_id, frame)),
objrow AS (SELECT *, 'object=' || object_id || ' bbox=' || printf('%.0f', x) || ',' || printf('%.0f', y) || ',' || printf('%.0f', w) || ',' || printf('%.0f', ht)
    || ' person_conf=' || printf('%.2f', confidence) AS log_row FROM obj)"""


@query("person_filter", DET, sql="SELECT stream_id, frame, det_order, class_id, confidence FROM det WHERE class_id = 0")
def person_filter(spark, sf):
    return D.persons(V.det(spark, sf)).select(*KEYS, "det_order", "class_id", "confidence")


@query("conf_filter", DET, sql="SELECT stream_id, frame, det_order, class_id, confidence FROM det WHERE confidence >= 0.2")
def conf_filter(spark, sf):
    return D.confident(V.det(spark, sf)).select(*KEYS, "det_order", "class_id", "confidence")


@query("assess_eligible", DET, sql="""SELECT stream_id, frame, det_order, width, height FROM det
  WHERE class_id = 0 AND width >= 8 AND height >= 8""")
def assess_eligible(spark, sf):
    return D.assessable(V.det(spark, sf)).select(*KEYS, "det_order", "width", "height")


@query("person_ordinal", DET, sql="""SELECT stream_id, frame, det_order, ordinal,
  CASE WHEN stored >= 1 THEN CAST(stored - 1 AS INT) ELSE ordinal END AS object_id FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY stream_id, frame ORDER BY det_order) - 1 AS INT) AS ordinal,
      CASE frame % 5 WHEN 0 THEN 0 WHEN 1 THEN det_order + 1 END AS stored FROM det WHERE class_id = 0)""")
def person_ordinal(spark, sf):
    stored = F.when(F.col("frame") % 5 == 0, 0).when(F.col("frame") % 5 == 1, F.col("det_order") + 1)
    hot = V.hot_frames(spark, sf)
    return D.number_persons(
            V.det(spark, sf, hot).withColumn("stored", stored), stored_id="stored", hot=hot
    ).select(*KEYS, "det_order", "ordinal", "object_id")


@query("topk_detections", DET, sql="""SELECT stream_id, frame, class_id, det_order, confidence, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY stream_id, frame, class_id ORDER BY confidence DESC, det_order) AS rank FROM det) WHERE rank <= 2""")
def topk_detections(spark, sf):
    return D.top_k(V.det(spark, sf), k=2).select(*KEYS, "class_id", "det_order", "confidence", "rank")


NMS = """r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame, class_id ORDER BY confidence DESC, det_order) AS rk FROM det WHERE confidence >= 0.2),
step AS (
  SELECT stream_id, frame, class_id, rk, [{'o': det_order, 'l': "left", 't': top, 'w': width, 'h': height, 'c': confidence}] AS kept FROM r WHERE rk = 1
  UNION ALL
  SELECT r.stream_id, r.frame, r.class_id, r.rk, CASE WHEN len(list_filter(s.kept, lambda k:
      least(k.l + k.w, r."left" + r.width) - greatest(k.l, r."left") > 0 AND least(k.t + k.h, r.top + r.height) - greatest(k.t, r.top) > 0
      AND (least(k.l + k.w, r."left" + r.width) - greatest(k.l, r."left")) * (least(k.t + k.h, r.top + r.height) - greatest(k.t, r.top))
        / (k.w * k.h + r.width * r.height - (least(k.l + k.w, r."left" + r.width) - greatest(k.l, r."left")) * (least(k.t + k.h, r.top + r.height) - greatest(k.t, r.top))) > 0.45)) > 0
    THEN s.kept ELSE list_append(s.kept, {'o': r.det_order, 'l': r."left", 't': r.top, 'w': r.width, 'h': r.height, 'c': r.confidence}) END
  FROM step s JOIN r ON r.stream_id = s.stream_id AND r.frame = s.frame AND r.class_id = s.class_id AND r.rk = s.rk + 1),
lastk AS (SELECT stream_id, frame, class_id, arg_max(kept, rk) AS kept FROM step GROUP BY ALL),
final AS (SELECT stream_id, frame, class_id, unnest(kept) AS u FROM lastk)"""


@query("nms", DET, NMS, recursive=True,
       sql="SELECT stream_id, frame, class_id, u.o AS det_order, u.c AS confidence FROM final")
def nms(spark, sf):
    hot = V.hot_frames(spark, sf)
    boxes = D.confident(V.det(spark, sf, hot))
    return S.suppress(boxes, hot=hot).select(*KEYS, "class_id", "det_order", "confidence")


@query("bbox_scale", FRM, DET, sql="""SELECT stream_id, frame, det_order, "left" * (img_w / src_w) AS x, top * (img_h / src_h) AS y,
  width * (img_w / src_w) AS w, height * (img_h / src_h) AS h FROM det JOIN frm USING (stream_id, frame)""")
def bbox_scale(spark, sf):
    sized = V.det(spark, sf).join(V.frm(spark, sf).select(*KEYS, "src_w", "src_h", "img_w", "img_h"), KEYS)
    b = F.col("b")
    return sized.withColumn("b", geometry.scale_bbox(geometry.bbox())).select(
        *KEYS, "det_order", *[b[i].alias(n) for i, n in enumerate("xywh")]
    )


@query("bbox_center", DET, sql="""SELECT stream_id, frame, det_order,
  CASE WHEN frame % 9 = 0 THEN 0.0::DOUBLE ELSE "left" + width / 2 END AS center_x,
  CASE WHEN frame % 9 = 0 THEN 0.0::DOUBLE ELSE top + height / 2 END AS center_y,
  CASE WHEN frame % 9 = 0 THEN 0.0::DOUBLE ELSE width END AS size_x,
  CASE WHEN frame % 9 = 0 THEN 0.0::DOUBLE ELSE height END AS size_y FROM det""")
def bbox_center(spark, sf):
    box = F.when(F.col("frame") % 9 != 0, geometry.bbox())
    return V.det(spark, sf).withColumn("c", geometry.center_size(box)).select(*KEYS, "det_order", "c.*")


@query("conf_color", DET, sql="""SELECT stream_id, frame, det_order,
  CASE WHEN confidence <= 0.2 THEN 1.0::DOUBLE WHEN confidence < 0.5 THEN 1.0::DOUBLE WHEN confidence < 0.8 THEN 1.0::DOUBLE - (confidence - 0.5::DOUBLE) / (0.8::DOUBLE - 0.5::DOUBLE) ELSE 0.0::DOUBLE END AS r,
  CASE WHEN confidence <= 0.2 THEN 0.0::DOUBLE WHEN confidence < 0.5 THEN (confidence - 0.2::DOUBLE) / (0.5::DOUBLE - 0.2::DOUBLE) ELSE 1.0::DOUBLE END AS g,
  0.0::DOUBLE AS b, 1.0::DOUBLE AS a FROM det""")
def conf_color(spark, sf):
    return V.det(spark, sf).withColumn("c", geometry.confidence_color("confidence", 0.2)).select(
        *KEYS, "det_order", "c.*"
    )


@query("overlay_segments", DET, """q AS (SELECT *, CAST(round_even("left" / 8, 0) AS BIGINT) AS x1, CAST(round_even(top / 8, 0) AS BIGINT) AS y1,
    CAST(round_even("left" / 8 + width / 8, 0) AS BIGINT) AS x2, CAST(round_even(top / 8 + height / 8, 0) AS BIGINT) AS y2,
    CASE frame % 3 WHEN 0 THEN 0 WHEN 1 THEN 720 ELSE 2160 END AS fh FROM det WHERE class_id = 0),
f AS (SELECT *, greatest(1, CAST(round_even((CASE WHEN fh = 0 THEN 1080 ELSE fh END) * 0.001::DOUBLE, 0) AS BIGINT)) AS font_size FROM q)""",
       sql="""SELECT stream_id, frame, det_order, CAST(s.i AS INT) AS side,
  CASE s.i WHEN 0 THEN x1 WHEN 1 THEN x2 WHEN 2 THEN x2 ELSE x1 END AS x1, CASE s.i WHEN 0 THEN y1 WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y2 END AS y1,
  CASE s.i WHEN 0 THEN x2 WHEN 1 THEN x2 WHEN 2 THEN x1 ELSE x1 END AS x2, CASE s.i WHEN 0 THEN y1 WHEN 1 THEN y2 WHEN 2 THEN y2 ELSE y1 END AS y2,
  'person ' || printf('%.2f', confidence) AS label, greatest(0, x1 - 1) AS x_offset,
  greatest(0, y1 - greatest(18, 2 * font_size + 8)) AS y_offset, font_size
  FROM f CROSS JOIN (VALUES (0), (1), (2), (3)) AS s(i)""")
def overlay_segments(spark, sf):
    eighth = geometry.bbox(*[F.col(c) / 8 for c in ("left", "top", "width", "height")])
    tall = F.when(F.col("frame") % 3 == 0, 0).when(F.col("frame") % 3 == 1, 720).otherwise(2160)
    return D.persons(V.det(spark, sf)).withColumn("box", eighth).select(
        *KEYS, "det_order", F.concat(F.lit("person "), text.fixed("confidence", 2)).alias("label"),
        geometry.overlay_label("box", tall).alias("place"),
        F.posexplode(geometry.overlay_segments("box")).alias("side", "s"),
    ).select(*KEYS, "det_order", "side", "s.*", "label", "place.*")


@query("data_source_id", FRM, sql="""SELECT stream_id, frame, CASE WHEN explicit_id IS NOT NULL THEN COALESCE(TRY_CAST(explicit_id AS BIGINT), 0)
  ELSE frame % 2147483647 END AS source_id FROM frm""")
def data_source_id(spark, sf):
    return V.frm(spark, sf).select(*KEYS, identity.data_source_id("explicit_id", "frame").alias("source_id"))


@query("timestamp_resolve", FRM, TSR, sql="SELECT stream_id, frame, source, ts_ns FROM tsr")
def timestamp_resolve(spark, sf):
    return V.frm(spark, sf).select(*KEYS, clock.resolve_timestamp().alias("t")).select(*KEYS, "t.*")


@query("ntp_to_unix", FRM, sql="""SELECT stream_id, frame, CASE WHEN ntp_raw > 2208988800000000000 THEN ntp_raw - 2208988800000000000 ELSE ntp_raw END AS ntp_unix,
  CASE WHEN ref_raw > 2208988800000000000 THEN ref_raw - 2208988800000000000 ELSE ref_raw END AS ref_unix FROM frm""")
def ntp_to_unix(spark, sf):
    return V.frm(spark, sf).select(
        *KEYS, clock.ntp_to_unix("ntp_raw").alias("ntp_unix"), clock.ntp_to_unix("ref_raw").alias("ref_unix")
    )


@query("timestamp_format", FRM, TSR, TXT, sql="SELECT stream_id, frame, source, ts_text FROM txt")
def timestamp_format(spark, sf):
    resolved = V.frm(spark, sf).select(*KEYS, clock.resolve_timestamp().alias("t"))
    return resolved.select(
        *KEYS, "t.source", clock.format_timestamp(F.col("t.source"), F.col("t.ts_ns")).alias("ts_text")
    )


@query("stamp_split", FRM, """x AS (SELECT stream_id, frame, CASE WHEN frame % 2 = 0 THEN unix_ns ELSE -pts END AS ns FROM frm)""",
       sql="""SELECT stream_id, frame, (ns - ((ns % 1000000000 + 1000000000) % 1000000000)) // 1000000000 AS sec,
  CAST((ns % 1000000000 + 1000000000) % 1000000000 AS INT) AS nanosec FROM x""")
def stamp_split(spark, sf):
    ns = F.when(F.col("frame") % 2 == 0, F.col("unix_ns")).otherwise(-F.col("pts"))
    return V.frm(spark, sf).select(*KEYS, clock.stamp(ns).alias("s")).select(*KEYS, "s.*")


@query("compute_fps", MRK, """lat AS (SELECT stream_id, frame, (infer - mux - 4000) / 1000.0::DOUBLE AS ms FROM wide)""",
       sql="""SELECT stream_id, frame, CASE WHEN ms > 0 THEN 1000.0::DOUBLE / ms END AS fps_ms,
  CASE WHEN ms > 0 THEN 1.0::DOUBLE / ms ELSE 0.0::DOUBLE END AS fps_s FROM lat""")
def compute_fps(spark, sf):
    wide = T.pivot_stages(V.mrk(spark, sf)).withColumn("ms", (F.col("infer") - F.col("mux") - 4000) / F.lit(1000.0))
    return wide.select(
        *KEYS, clock.rate_from_ms("ms").alias("fps_ms"), clock.rate_from_seconds("ms").alias("fps_s")
    )


def detect_records(spark, sf) -> DataFrame:
    hot = V.hot_frames(spark, sf)
    return P.detect_records(V.frm(spark, sf), V.det(spark, sf, hot), hot=hot)


@query("frame_objects", FRM, DET, NUM, sql="""SELECT f.stream_id, f.frame, count(n.object_id) AS object_count,
  COALESCE(string_agg(CAST(n.object_id AS VARCHAR) || '@' || n.det_order, ',' ORDER BY n.det_order), '') AS ids
  FROM frm f LEFT JOIN num n USING (stream_id, frame) GROUP BY f.stream_id, f.frame""")
def frame_objects(spark, sf):
    hot = V.hot_frames(spark, sf)
    numbered = D.number_persons(D.confident(V.det(spark, sf, hot)), hot=hot)
    nested = R.nest_objects(numbered, ["object_id", "det_order"], hot=hot)
    whole = R.attach_objects(V.frm(spark, sf).select(*KEYS), nested, hot=hot)
    label = F.transform("objects", lambda o: F.concat(o["object_id"].cast("string"), F.lit("@"), o["det_order"].cast("string")))
    return whole.select(*KEYS, "object_count", F.array_join(label, ",").alias("ids"))


@query("detect_objects", FRM, DET, NUM, OBJ, sql="""SELECT stream_id, frame, object_id AS object_index, object_id, x, y, w, ht AS h, sx, sy, sw, sh,
  'person' AS class_name, confidence FROM obj""")
def detect_objects(spark, sf):
    hot = V.hot_frames(spark, sf)
    o = P.detected_persons(V.frm(spark, sf), V.det(spark, sf, hot), hot=hot)
    return o.select(
        *KEYS, "object_index", "object_id", *[F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")],
        *[F.col("source_bbox")[i].alias(n) for i, n in enumerate(("sx", "sy", "sw", "sh"))],
        "class_name", "confidence",
    )


@query("detect_log_rows", FRM, DET, NUM, OBJ, sql="SELECT stream_id, frame, object_id, log_row FROM objrow")
def detect_log_rows(spark, sf):
    hot = V.hot_frames(spark, sf)
    o = P.detected_persons(V.frm(spark, sf), V.det(spark, sf, hot), hot=hot)
    return o.select(*KEYS, "object_id", text.detect_row("object_id", "bbox", "confidence").alias("log_row"))


@query("clustered_objects", FRM, DET, NMS, """best AS (SELECT * FROM (SELECT stream_id, frame, class_id, u.o AS det_order, u.c AS confidence,
    row_number() OVER (PARTITION BY stream_id, frame, class_id ORDER BY u.c DESC, u.o) AS rank FROM final) WHERE rank <= 300)""", recursive=True,
       sql="""SELECT f.stream_id, f.frame, CAST(row_number() OVER (PARTITION BY f.stream_id, f.frame ORDER BY det_order) - 1 AS INT) AS object_id, b.confidence
  FROM frm f JOIN best b USING (stream_id, frame) WHERE class_id = 0""")
def clustered_objects(spark, sf):
    """Persons of the detector's whole chain: threshold, suppression, best 300 per class."""
    records = P.clustered_records(V.frm(spark, sf), V.det(spark, sf))
    return records.select(*KEYS, F.inline("objects")).select(*KEYS, "object_id", "confidence")


LOGTXT = """agg AS (SELECT stream_id, frame, count(*) AS n, string_agg('  ' || log_row, chr(10) ORDER BY det_order) AS body FROM objrow GROUP BY ALL),
meta AS (SELECT f.*, COALESCE(a.n, 0) AS object_count, 'DETECT frame=' || f.frame || ' timestamp=' || ts_text || ' timestamp_source=' || source
    || ' source=' || src_w || 'x' || src_h || ' image=' || img_w || 'x' || img_h || COALESCE(chr(10) || body, '') AS log_text
  FROM txt f LEFT JOIN agg a USING (stream_id, frame))"""


@query("frame_metadata", FRM, DET, NUM, OBJ, TSR, TXT, LOGTXT, sql="""SELECT stream_id, 'DETECT' AS stage, frame, ts_ns AS timestamp_ns, ts_text AS timestamp,
  source AS timestamp_source, ts_ns AS source_timestamp_ns, true AS timestamp_is_source, object_count, frame % 2147483647 AS data_source_id,
  src_w AS source_width, src_h AS source_height, img_w AS image_width, img_h AS image_height, 'image' AS bbox_coordinate_space FROM meta""")
def frame_metadata(spark, sf):
    return R.frame_metadata(detect_records(spark, sf), "DETECT").select(
        "stream_id", "stage", "frame", "timestamp_ns", "timestamp", "timestamp_source", "source_timestamp_ns",
        "timestamp_is_source", "object_count", "data_source_id", "source_width", "source_height", "image_width",
        "image_height", "bbox_coordinate_space",
    )


@query("log_text", FRM, DET, NUM, OBJ, TSR, TXT, LOGTXT, sql="SELECT stream_id, frame, log_text FROM meta")
def log_text(spark, sf):
    return R.frame_metadata(detect_records(spark, sf), "DETECT").select(*KEYS, "log_text")


@query("image_records", FRM, TSR, TXT, sql="""SELECT stream_id, 'IMAGE' AS stage, frame, ts_ns AS timestamp_ns, ts_text AS timestamp, source AS timestamp_source,
  frame % 2147483647 AS data_source_id, CAST(0 AS BIGINT) AS object_count, src_w AS source_width, src_h AS source_height, img_w AS image_width,
  img_h AS image_height, 'image' AS bbox_coordinate_space, buf_key, arrival_seq FROM txt""")
def image_records(spark, sf):
    return R.image_records(V.frm(spark, sf))


STAMP = """(ts_ns - ((ts_ns % 1000000000 + 1000000000) % 1000000000)) // 1000000000 AS sec,
  CAST((ts_ns % 1000000000 + 1000000000) % 1000000000 AS INT) AS nanosec"""


@query("image_messages", FRM, PAY, TSR, sql=f"""SELECT t.stream_id, t.frame, {STAMP}, 'camera' AS frame_id, 'jpeg' AS format, n_bytes
  FROM tsr t JOIN pay p ON t.stream_id = p.stream_id AND t.buf_key = p.buf_key""")
def image_messages(spark, sf):
    joined = P.images_with_payload(V.frm(spark, sf), V.pay(spark, sf))
    return M.image_messages(joined).select(*KEYS, "stamp.sec", "stamp.nanosec", "frame_id", "format", "n_bytes")


@query("target_box_array", FRM, DET, NUM, OBJ, TSR, sql=f"""SELECT t.stream_id, t.frame, {STAMP}, CAST(0 AS INT) AS system_id, 1.0::DOUBLE AS gimbal_w,
  false AS use_for_mosaic, 'DETECTION_YOLO' AS detection_source, o.object_id AS box_index,
  CASE WHEN o.object_id IS NOT NULL THEN t.frame % 2147483647 END AS box_source_id,
  o.x + o.w / 2 AS center_x, o.y + o.ht / 2 AS center_y, o.w AS size_x, o.ht AS size_y,
  CASE WHEN o.object_id IS NOT NULL THEN 'person' END AS detection_class, o.confidence AS detection_confidence
  FROM tsr t LEFT JOIN obj o USING (stream_id, frame)""")
def target_box_array(spark, sf):
    hot = V.hot_frames(spark, sf)
    messages = P.target_boxes(V.frm(spark, sf), V.det(spark, sf, hot), hot=hot)
    return messages.select(
        *KEYS, "stamp.sec", "stamp.nanosec", "system_id", "gimbal_w", "use_for_mosaic", "detection_source",
        F.posexplode_outer("uav_target_boxes").alias("box_index", "b"),
    ).select(
        *KEYS, "sec", "nanosec", "system_id", "gimbal_w", "use_for_mosaic", "detection_source", "box_index",
        F.col("b.data_source_id").alias("box_source_id"), "b.center_x", "b.center_y", "b.size_x", "b.size_y",
        "b.detection_class", "b.detection_confidence",
    )


@query("publisher_seq", FRM, sql="""SELECT stream_id, frame, row_number() OVER (PARTITION BY stream_id ORDER BY arrival_seq) - 1 AS seq FROM frm""")
def publisher_seq(spark, sf):
    return M.publisher_sequence(V.frm(spark, sf).select(*KEYS, "arrival_seq")).select(*KEYS, "seq")


def stage_of() -> F.Column:
    return F.when(F.col("frame") % 3 == 0, "IMAGE").when(F.col("frame") % 3 == 1, "DETECT").otherwise("ASSESS")


@query("topic_route", FRM, sql="""SELECT stream_id, frame, CASE frame % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'target_detections' ELSE 'casualty' END AS topic FROM frm
  WHERE frame % 10 <> 9""")
def topic_route(spark, sf):
    stage = F.when(F.col("frame") % 10 != 9, stage_of()).otherwise(F.lit("OTHER"))
    return M.route(V.frm(spark, sf).withColumn("stage", stage)).select(*KEYS, "topic")


@query("publish_audit", FRM, PAY, DET, NUM, """m AS (SELECT t.stream_id, t.frame, CASE t.frame % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'target_detections' ELSE 'casualty' END AS topic, n_bytes
  FROM frm t JOIN pay p ON t.stream_id = p.stream_id AND t.buf_key = p.buf_key),
c AS (SELECT stream_id, frame, count(*) AS n FROM num GROUP BY ALL)""",
       sql="""SELECT topic, count(*) AS packets, CAST(sum(CASE WHEN topic = 'casualty' THEN COALESCE(n, 0) ELSE 1 END) AS BIGINT) AS messages,
  CAST(sum(n_bytes) AS BIGINT) AS bytes FROM m LEFT JOIN c USING (stream_id, frame) GROUP BY topic""")
def publish_audit(spark, sf):
    stage = stage_of()
    joined = P.images_with_payload(V.frm(spark, sf), V.pay(spark, sf)).withColumn("stage", stage)
    counts = D.persons(D.confident(V.det(spark, sf))).groupBy(*KEYS).agg(F.count("*").alias("n"))
    sent = M.route(joined.join(counts, KEYS, "left")).withColumn(
        "messages", F.when(F.col("topic") == "casualty", F.coalesce("n", F.lit(0))).otherwise(1)
    )
    return M.publish_audit(sent)


@query("payload_join", FRM, PAY, sql="""SELECT f.stream_id, f.frame, f.buf_key, p.n_bytes FROM frm f JOIN pay p ON f.stream_id = p.stream_id AND f.buf_key = p.buf_key""")
def payload_join(spark, sf):
    return P.images_with_payload(V.frm(spark, sf), V.pay(spark, sf)).select(*KEYS, "buf_key", "n_bytes")
