"""Queries over labels, sources, registries, checkpoints and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlake.constants import DETECTOR_CLASSES, HEADS
from sightlake.operators import catalog as C
from sightlake.operators.records import frame_metadata as metadata_record, image_records
from sightlake.plans import detect as P
from sightlake.plans.assess import assess_records
from sightlake.plans.wire import build_packets, publish_casualties, publish_log, publish_packets, publish_targets
from sightlake.session import new_path
from sightlake.sources import lookups as L, packets as K

from . import views as V
from .frames import LOGTXT, NUM, OBJ, STAMP, TSR, TXT, detect_records
from .registry import query
from .state import greedy
from .tensors import ALL
from .views import CKPT, DET, FRM, PAY, REG, SRC

_classes = ", ".join(f"({i}, '{name}')" for i, name in enumerate(DETECTOR_CLASSES))


@query("label_dim", DET, f"lab(class_id, class_name) AS (VALUES {_classes})",
       sql="""SELECT class_id, class_name, count(*) AS boxes FROM (SELECT CAST(class_id * 11 AS INT) AS class_id FROM det) JOIN lab USING (class_id) GROUP BY class_id, class_name""")
def label_dim(spark, sf):
    """Boxes per class name, with the class list written as a label file and scanned back."""
    path = new_path(spark, "labels")
    names = L.detector_labels(spark).orderBy("class_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_id", "name"))), lambda x: x["name"]), "\n")
        .alias("value")
    )
    names.coalesce(1).write.text(path)
    boxes = V.det(spark, sf).select((F.col("class_id") * 11).alias("class_id"))
    named = L.with_class_name(boxes.groupBy("class_id").agg(F.count("*").alias("boxes")), L.read_labels(spark, path))
    return named.select("class_id", "class_name", "boxes")


@query("registry_scan", REG, sql="SELECT name, stem, long_side, requested_long_side, source_width, source_height, model_width, model_height FROM reg")
def registry_scan(spark, sf):
    return L.parse_registry(V.reg_json(spark, sf))


@query("registry_match", SRC, REG, """m AS (SELECT s.source_id, s.src_w, s.src_h, s.long_side, r.name, r.model_width, r.model_height,
    row_number() OVER (PARTITION BY s.source_id ORDER BY r.name) AS rn FROM src s LEFT JOIN reg r ON r.stem = s.stem AND r.long_side = s.long_side
    AND (r.requested_long_side IS NULL OR r.requested_long_side = s.long_side) AND (r.source_width IS NULL OR r.source_width = s.src_w)
    AND (r.source_height IS NULL OR r.source_height = s.src_h))""", """sized AS (SELECT *, greatest(32, (long_side + 31) // 32 * 32) AS big,
    greatest(32, (CAST(floor(CAST(long_side * least(src_w, src_h) AS DOUBLE) / greatest(src_w, src_h)) AS BIGINT) + 31) // 32 * 32) AS small FROM m WHERE rn = 1)""",
       sql="""SELECT source_id, name AS model, CAST(CASE WHEN name IS NULL THEN NULL WHEN model_width IS NOT NULL THEN model_width WHEN src_w >= src_h THEN big ELSE small END AS BIGINT) AS input_w,
  CAST(CASE WHEN name IS NULL THEN NULL WHEN model_width IS NOT NULL THEN model_height WHEN src_w >= src_h THEN small ELSE big END AS BIGINT) AS input_h FROM sized""")
def registry_match(spark, sf):
    requests = V.src(spark, sf).select("source_id", "stem", "long_side", "src_w", "src_h")
    return C.match_registry(requests, L.parse_registry(V.reg_json(spark, sf))).select(
        "source_id", "model", "input_w", "input_h"
    )


@query("source_resolve", SRC, """p AS (SELECT *, regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS tail FROM src JOIN pages ON page_id = source_id),
q AS (SELECT *, list_filter(string_split(tail, '/'), lambda x: x <> '') AS steps FROM p),
e AS (SELECT *, list_aggregate(steps, 'string_agg', '/') AS clean, list_aggregate(list_slice(steps, 1, len(steps) - 1), 'string_agg', '/') AS parent,
  ends_with(tail, '/') AS open_end FROM q)""",
       sql="""SELECT source_id, raw, CASE source_id % 6 WHEN 2 THEN '/media/my clip/' || tail WHEN 3 THEN '/data/streams/' || tail WHEN 4 THEN raw END AS path,
  CASE source_id % 6 WHEN 2 THEN 'file:///media/my%20clip/' || clean WHEN 3 THEN 'file:///data/streams/' || clean
    WHEN 4 THEN 'file:///abs/' || CASE WHEN parent IS NULL OR parent = '' THEN '' ELSE parent || '/' END || 'demo%20file.avi' ELSE raw END AS uri,
  source_id % 6 IN (0, 1) AS is_rtsp FROM e""")
def source_resolve(spark, sf):
    return C.resolve_sources(V.src(spark, sf)).select("source_id", "raw", "path", "uri", "is_rtsp")


@query("codec_family", SRC, sql="""SELECT source_id, CASE WHEN contains(lower(caps), 'h.265') OR contains(lower(caps), 'h265') OR contains(lower(caps), 'hevc') THEN 'h265'
  WHEN contains(lower(caps), 'h.264') OR contains(lower(caps), 'h264') OR contains(lower(caps), 'avc') THEN 'h264' ELSE 'encode-h264' END AS family FROM src WHERE caps IS NOT NULL""")
def codec_family(spark, sf):
    return C.codec_families(V.src(spark, sf)).select("source_id", "family")


@query("model_input_size", SRC, """s AS (SELECT *, greatest(32, (long_side + 31) // 32 * 32) AS big,
    greatest(32, (CAST(floor(CAST(long_side * least(src_w, src_h) AS DOUBLE) / greatest(src_w, src_h)) AS BIGINT) + 31) // 32 * 32) AS small FROM src)""",
       sql="""SELECT source_id, CAST(CASE WHEN src_w >= src_h THEN big ELSE small END AS BIGINT) AS input_w,
  CAST(CASE WHEN src_w >= src_h THEN small ELSE big END AS BIGINT) AS input_h FROM s""")
def model_input_size(spark, sf):
    return C.input_sizes(V.src(spark, sf)).select("source_id", "input_w", "input_h")


_required = ", ".join(f"('heads.{h}.{part}')" for h in HEADS for part in ("weight", "bias"))


@query("missing_weights", CKPT, f"req(key) AS (VALUES {_required})",
       sql="""SELECT c.ckpt, req.key FROM (SELECT DISTINCT ckpt FROM ckpt) c CROSS JOIN req
  WHERE NOT EXISTS (SELECT 1 FROM ckpt x WHERE x.ckpt = c.ckpt AND x.key = req.key)""")
def missing_weights(spark, sf):
    return C.missing_weights(V.ckpt(spark, sf))


@query("checkpoint_spec", CKPT, r"""b AS (SELECT ckpt, count(*) AS state_dict_keys,
    count(DISTINCT TRY_CAST(regexp_extract(key, '^clip_model\.visual\.transformer\.resblocks\.([0-9]+)\.', 1) AS INT)) AS visual_layers,
    count(DISTINCT TRY_CAST(regexp_extract(key, '^clip_model\.transformer\.resblocks\.([0-9]+)\.', 1) AS INT)) AS transformer_layers,
    max(dim0) FILTER (key = 'clip_model.visual.positional_embedding') AS pos, max(dim1) FILTER (key = 'clip_model.visual.conv1.weight') AS patch_size,
    max(dim0) FILTER (key = 'clip_model.visual.conv1.weight') AS visual_width, max(dim1) FILTER (key = 'clip_model.visual.proj') AS embedding_dim,
    max(dim0) FILTER (key = 'clip_model.positional_embedding') AS context_length, max(dim0) FILTER (key = 'clip_model.token_embedding.weight') AS vocab_size,
    max(dim1) FILTER (key = 'clip_model.token_embedding.weight') AS transformer_width FROM ckpt GROUP BY ckpt),
g AS (SELECT *, CAST(round_even(sqrt(pos - 1), 0) AS INT) AS visual_grid FROM b)""",
       sql="""SELECT ckpt, state_dict_keys, visual_layers, transformer_layers, patch_size, visual_width, embedding_dim, context_length, vocab_size, transformer_width,
  visual_grid, CAST(visual_grid * patch_size AS INT) AS image_resolution, CAST(visual_width // 64 AS INT) AS visual_heads, CAST(transformer_width // 64 AS INT) AS transformer_heads FROM g""")
def checkpoint_spec(spark, sf):
    return C.checkpoint_spec(V.ckpt(spark, sf))


@query("head_shapes", CKPT, sql=r"""SELECT ckpt, regexp_extract(key, '^heads\.(.*)\.weight$', 1) AS head, dim0 AS classes, dim1 AS in_features FROM ckpt
  WHERE key LIKE 'heads.%.weight'""")
def head_shapes(spark, sf):
    return C.head_shapes(V.ckpt(spark, sf))


PACKETS = """pk AS (SELECT t.*, CASE frame % 6 WHEN 0 THEN NULL WHEN 1 THEN ' 1_000 ' WHEN 2 THEN '1.5' WHEN 3 THEN 'x' ELSE CAST(ts_ns AS VARCHAR) END AS src_text FROM tsr t)"""


def _packets(spark, sf):
    """Image packets; keys are missing or malformed in turn, the payload is the event's own text."""
    f = F.col("frame")
    records = metadata_record(detect_records(spark, sf), "DETECT")
    props = V.table(spark, sf, "events").select(F.col("event_id").alias("frame"), "props")
    stamp = F.col("source_timestamp_ns").cast("string")
    varied = F.when(f % 6 == 1, " 1_000 ").when(f % 6 == 2, "1.5").when(f % 6 == 3, "x").when(f % 6 > 3, stamp)
    body = records.join(props, "frame").withColumn("source_timestamp_ns", varied)
    kept = ["stage", "timestamp_ns", "timestamp", "timestamp_source", "source_timestamp_ns", "objects", "object_count"]
    optional = [
        F.when(f % 5 != 0, f).alias("frame"),
        F.when(f % 4 == 0, F.lit("bad")).when(f % 4 == 1, f.cast("string")).alias("data_source_id"),
        F.when(f % 3 == 0, F.lit("png")).alias("format"), F.when(f % 2 == 0, F.lit("é log")).alias("log_text"),
        F.octet_length("props").cast("bigint").alias("bytes"),
    ]
    empty = f % 8 == 0
    return body.select(
        F.to_json(F.struct(*kept, *optional)).alias("metadata"),
        F.when(empty, F.lit("")).otherwise(F.col("props")).cast("binary").alias("payload"),
    )


def _written(spark, sf):
    path = new_path(spark, "packets")
    K.write_packets(_packets(spark, sf), path, roll_bytes=1_000_000)
    return K.read_packets(spark, path)


@query("packet_fetch", sql="""SELECT CASE WHEN event_id % 8 = 0 THEN '' ELSE props END AS payload, count(*) AS n FROM events GROUP BY ALL""")
def packet_fetch(spark, sf):
    """Headers first, payloads by reference afterwards."""
    path = new_path(spark, "packets")
    K.write_packets(_packets(spark, sf), path, roll_bytes=1_000_000)
    heads = K.read_packets(spark, path, payload=False)
    body = K.load_payload("path", "offset", "n_bytes").cast("string").alias("payload")
    return heads.select(body).groupBy("payload").agg(F.count("*").alias("n"))


COUNTS = """cnt AS (SELECT stream_id, frame, count(*) AS n FROM num GROUP BY ALL)"""


@query("packet_scan", sql="""SELECT count(*) AS packets, CAST(sum(CASE WHEN event_id % 8 = 0 THEN 0 ELSE strlen(props) END) AS BIGINT) AS payload_bytes FROM events""")
def packet_scan(spark, sf):
    scanned = _written(spark, sf)
    return scanned.agg(F.count("*").alias("packets"), F.sum(F.octet_length("payload")).cast("bigint").alias("payload_bytes"))


@query("packet_roundtrip", sql="""SELECT event_id % 8 = 0 AS is_empty, CASE WHEN event_id % 8 = 0 THEN '' ELSE props END AS payload, count(*) AS n FROM events GROUP BY ALL""")
def packet_roundtrip(spark, sf):
    scanned = _written(spark, sf).select(F.col("payload").cast("string").alias("payload"))
    return scanned.groupBy((F.col("payload") == "").alias("is_empty"), "payload").agg(F.count("*").alias("n"))


@query("metadata_parse", FRM, DET, NUM, TSR, PACKETS, COUNTS, sql="""SELECT 'DETECT' AS stage, CASE WHEN pk.frame % 5 <> 0 THEN pk.frame END AS frame, source AS timestamp_source,
  CASE pk.frame % 4 WHEN 0 THEN 0 WHEN 1 THEN pk.frame ELSE CASE WHEN pk.frame % 5 <> 0 THEN pk.frame % 2147483647 ELSE 0 END END AS data_source_id,
  CASE WHEN pk.frame % 3 = 0 THEN 'png' ELSE 'jpeg' END AS format, CASE WHEN pk.frame % 2 = 0 THEN 'é log' ELSE 'metadata=missing' END AS log_text,
  COALESCE(n, 0) AS objects, strlen(props) AS bytes
  FROM pk LEFT JOIN cnt USING (stream_id, frame) JOIN events ON event_id = pk.frame""")
def metadata_parse(spark, sf):
    parsed = K.parse_metadata(_written(spark, sf))
    return parsed.select(
        "stage", "frame", "timestamp_source", "data_source_id", "format", "log_text",
        F.size("objects").cast("bigint").alias("objects"), "bytes",
    )


@query("message_timestamp", FRM, TSR, PACKETS, sql="""SELECT CASE WHEN frame % 5 <> 0 THEN frame END AS frame, COALESCE(CASE WHEN frame % 6 = 1 THEN 1000 WHEN frame % 6 > 3 THEN ts_ns END, ts_ns) AS message_ts_ns FROM pk""")
def message_timestamp(spark, sf):
    return K.parse_metadata(_written(spark, sf)).select("frame", "message_ts_ns")


@query("metadata_types", sql="""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN event_id WHEN 4 THEN event_id WHEN 5 THEN 0 ELSE 7 END AS source_id,
  CASE event_id % 7 WHEN 1 THEN 1 WHEN 3 THEN event_id WHEN 4 THEN event_id ELSE 5 END AS message_ts_ns,
  CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN event_id WHEN 4 THEN event_id WHEN 6 THEN 7 END AS frame FROM events""")
def metadata_types(spark, sf):
    """Integers in packet metadata by their JSON type."""
    k, own = F.col("event_id") % 7, F.col("event_id").cast("string")
    value = (
        F.when(k == 0, "1.5").when(k == 1, "true").when(k == 2, '"1.5"').when(k == 3, own)
        .when(k == 4, F.concat(F.lit('"\\t '), own, F.lit(' "'))).when(k == 5, "[1]").otherwise("7.0")
    )
    text = F.concat(*[x for key in ("data_source_id", "source_timestamp_ns", "frame") for x in (F.lit(f'"{key}":'), value, F.lit(","))])
    packets = V.table(spark, sf, "events").select("event_id", F.concat(F.lit("{"), text, F.lit('"timestamp_ns":5}')).alias("metadata"))
    return K.parse_metadata(packets).select("event_id", F.col("data_source_id").alias("source_id"), "message_ts_ns", "frame")


BUILT = """puts AS (SELECT *, buf_key // 100000000 AS slot FROM tsr WHERE frame % 6 < 3),
pays AS (SELECT *, buf_key // 100000000 AS slot FROM pay),
prior AS (SELECT stream_id, slot, arrival_seq, n_bytes, lag(arrival_seq) OVER (PARTITION BY stream_id, slot ORDER BY arrival_seq) AS before FROM pays),
hit AS (SELECT p.stream_id, p.arrival_seq, p.n_bytes, max(t.frame) AS own FROM prior p LEFT JOIN puts t ON p.stream_id = t.stream_id AND p.slot = t.slot
  AND t.arrival_seq <= p.arrival_seq AND (p.before IS NULL OR t.arrival_seq > p.before) GROUP BY ALL),
built AS (SELECT h.stream_id, h.arrival_seq, h.n_bytes, COALESCE(own, f.frame) AS frame, own IS NOT NULL AS matched FROM hit h
  ASOF LEFT JOIN puts f ON h.stream_id = f.stream_id AND h.arrival_seq >= f.arrival_seq)"""


def _built(spark, sf):
    """Buffer keys are shared by a few frames each, so that keys repeat."""
    slot = F.expr("buf_key div 100000000").alias("buf_key")
    records = image_records(V.frm(spark, sf).filter(F.col("frame") % 6 < 3))
    records = records.select(*[slot if c == "buf_key" else c for c in records.columns])
    payloads = V.pay(spark, sf).select("stream_id", slot, "arrival_seq", "n_bytes")
    return build_packets(records, payloads, "IMAGE")


@query("packet_build", FRM, PAY, TSR, BUILT, sql="""SELECT stream_id, arrival_seq, frame, n_bytes AS bytes, 'jpeg' AS format, CASE WHEN frame IS NULL THEN 'IMAGE metadata=missing' END AS log_text FROM built""")
def packet_build(spark, sf):
    """Own record, newest record of the stream, or stub; keys that repeat match in arrival order."""
    get = lambda key: F.get_json_object("metadata", f"$.{key}")
    return _built(spark, sf).select(
        "stream_id", "arrival_seq", get("frame").cast("bigint").alias("frame"), get("bytes").cast("bigint").alias("bytes"),
        get("format").alias("format"), get("log_text").alias("log_text"),
    )


def _sent(spark, sf, packets):
    """Packets with the event's text as image, written to files and read back; the record names stream and arrival."""
    props = V.table(spark, sf, "events").select(F.col("event_id").alias("arrival_seq"), F.col("props").cast("binary").alias("payload"))
    path = new_path(spark, "packets")
    K.write_packets(packets.join(props, "arrival_seq"), path, roll_bytes=1_000_000)
    own = F.from_json("metadata", "stream_id int, arrival_seq bigint")
    return K.read_packets(spark, path).select("metadata", "payload", own["stream_id"].alias("stream_id"), own["arrival_seq"].alias("arrival_seq"))


def _detect_packets(spark, sf):
    record = metadata_record(detect_records(spark, sf), "DETECT")
    return record.select("arrival_seq", F.to_json(F.struct("*")).alias("metadata"))


def _assess_packets(spark, sf):
    hot = V.hot_frames(spark, sf)
    records = assess_records(V.frm(spark, sf), V.det(spark, sf, hot), V.logit(spark, sf), hot=hot)
    record = metadata_record(records, "ASSESS")
    return record.select("arrival_seq", F.to_json(F.struct("*")).alias("metadata"))


# unknown source times take the time of receipt
RECEIVED = """sent AS (SELECT t.* REPLACE (COALESCE(ts_ns, arrival_seq * 1000000) AS ts_ns), strlen(props) AS data_bytes FROM tsr t JOIN events ON event_id = t.arrival_seq)"""


@query("publish_packets", FRM, PAY, TSR, BUILT, sql="""SELECT b.stream_id, b.arrival_seq, b.frame, row_number() OVER (PARTITION BY b.stream_id ORDER BY b.arrival_seq) - 1 AS seq,
  (ts_ns - ts_ns % 1000000000) // 1000000000 AS sec, 'jpeg' AS format, strlen(props) AS data_bytes
  FROM built b JOIN events ON event_id = b.arrival_seq LEFT JOIN tsr t ON t.stream_id = b.stream_id AND t.frame = b.frame""")
def publish_packets_(spark, sf):
    """Packets read back from files, parsed, routed, numbered and published with their bytes."""
    ids = F.to_json(F.struct("stream_id", "arrival_seq"))
    named = F.concat(F.expr("left(_ids, length(_ids) - 1)"), F.lit(","), F.expr("substring(metadata, 2)"))
    packets = _built(spark, sf).withColumn("_ids", ids).select("arrival_seq", named.alias("metadata"))
    sent = publish_packets(_sent(spark, sf, packets))
    return sent.select(
        "stream_id", "arrival_seq", "frame", "seq", "stamp.sec", "format", F.octet_length("data").cast("bigint").alias("data_bytes")
    )


@query("publish_targets", FRM, DET, NUM, OBJ, TSR, RECEIVED, """nr AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY arrival_seq) - 1 AS seq FROM sent)""",
       sql=f"""SELECT t.stream_id, t.arrival_seq, seq, {STAMP}, data_bytes, object_id AS box_index, x + w / 2 AS center_x, y + ht / 2 AS center_y, w AS size_x, ht AS size_y,
  confidence, CASE WHEN object_id IS NOT NULL THEN CAST(t.frame % 2147483647 AS BIGINT) END AS source_id, CASE WHEN object_id IS NOT NULL THEN 'person' END AS class_name
  FROM nr t LEFT JOIN obj USING (stream_id, frame)""")
def publish_targets_(spark, sf):
    """Detect packets read back from files, as box arrays with number, stamp, image bytes and boxes."""
    packets = _sent(spark, sf, _detect_packets(spark, sf)).withColumn("received_ns", F.col("arrival_seq") * 1_000_000)
    boxes = publish_targets(packets, ingest="received_ns").select("*", F.posexplode_outer("uav_target_boxes").alias("box_index", "b"))
    return boxes.select(
        "stream_id", "arrival_seq", "seq", "stamp.sec", "stamp.nanosec", F.octet_length("source_img.data").cast("bigint").alias("data_bytes"),
        "box_index", "b.center_x", "b.center_y", "b.size_x", "b.size_y", F.col("b.detection_confidence").alias("confidence"),
        F.col("b.data_source_id").cast("bigint").alias("source_id"), F.col("b.detection_class").alias("class_name"),
    )


@query("publish_casualties", *ALL, TSR, RECEIVED, sql=f"""SELECT t.stream_id, t.arrival_seq, a.object_id, CAST(t.frame % 2147483647 AS BIGINT) AS source_id, {STAMP}, data_bytes,
  a.x AS bbox_x, a.y AS bbox_y, a.w AS bbox_width, a.ht AS bbox_height, 'clip_rgb_' || head AS field_name, round(probabilities[1], 6) AS o0
  FROM sent t JOIN aobj a USING (stream_id, frame) JOIN pred p USING (stream_id, frame, object_id)""")
def publish_casualties_(spark, sf):
    """Assess packets read back from files, one message per person, each with the packet's image bytes."""
    packets = _sent(spark, sf, _assess_packets(spark, sf)).withColumn("received_ns", F.col("arrival_seq") * 1_000_000)
    people = publish_casualties(packets, ingest="received_ns").select("*", F.inline("annotations"))
    return people.select(
        "stream_id", "arrival_seq", "object_id", F.col("data_source_id").cast("bigint").alias("source_id"), "stamp.sec", "stamp.nanosec",
        F.octet_length("image.data").cast("bigint").alias("data_bytes"), "bbox_x", "bbox_y", "bbox_width", "bbox_height",
        "field_name", F.round(F.get("observation", 0), 6).alias("o0"),
    )


LOG_EVERY = 50_000


@query("publish_log", *ALL, OBJ, TSR, TXT, LOGTXT, RECEIVED,
       """t AS (SELECT stream_id * 2 AS stream_id, frame, arrival_seq * 1000 AS ts_us FROM frm
  UNION ALL SELECT DISTINCT a.stream_id * 2 + 1, a.frame, f.arrival_seq * 1000 FROM aobj a JOIN frm f USING (stream_id, frame))""",
       greedy("t", LOG_EVERY), recursive=True,
       sql="""SELECT s.stream_id, s.arrival_seq, t.stream_id % 2 = 1 AS casualty, CAST(n AS BIGINT) AS messages, data_bytes AS n_bytes,
  'published topic=' || CASE t.stream_id % 2 WHEN 1 THEN 'casualty' ELSE 'target_detections' END || ' messages=' || n || ' bytes=' || data_bytes
    || CASE t.stream_id % 2 WHEN 1 THEN '' ELSE chr(10) || m.log_text END AS text
  FROM t JOIN g ON t.stream_id = g.stream_id AND t.ts_us = g.ts_us JOIN sent s ON s.stream_id = t.stream_id // 2 AND s.frame = t.frame
  JOIN meta m ON m.stream_id = s.stream_id AND m.frame = s.frame
  LEFT JOIN (SELECT stream_id, frame, count(*) AS k FROM aobj GROUP BY ALL) c ON c.stream_id = s.stream_id AND c.frame = s.frame,
  LATERAL (SELECT CASE t.stream_id % 2 WHEN 1 THEN k ELSE 1 END AS n)""")
def publish_log_(spark, sf):
    """Log lines of detect and assess publishers, sampled by time of receipt; whole text for detect packets."""
    packets = _sent(spark, sf, _detect_packets(spark, sf).unionByName(_assess_packets(spark, sf)))
    lines = publish_log(packets.withColumn("received_us", F.col("arrival_seq") * 1_000), LOG_EVERY, "received_us")
    casualty = F.col("topic") == "casualty"
    text = F.when(casualty, F.substring_index("text", "\n", 1)).otherwise(F.col("text"))
    return lines.select("stream_id", "arrival_seq", casualty.alias("casualty"), "messages", "n_bytes", text.alias("text"))
