"""Jobs over source, registry and checkpoint tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import HEADS
from ..functions.geometry import model_input_size

# fixed values: text that identifies a codec family, and the key patterns of checkpoints
H265_MARKS = ("h.265", "h265", "hevc")
H264_MARKS = ("h.264", "h264", "avc")
VISUAL_PREFIX = "clip_model.visual.transformer.resblocks."
TEXT_PREFIX = "clip_model.transformer.resblocks."
VISUAL_BLOCK = r"^clip_model\.visual\.transformer\.resblocks\.([0-9]+)\."
TEXT_BLOCK = r"^clip_model\.transformer\.resblocks\.([0-9]+)\."
# checkpoint tensors whose shape defines the model
VISUAL_POSITIONS = "clip_model.visual.positional_embedding"
VISUAL_CONV = "clip_model.visual.conv1.weight"
VISUAL_PROJECTION = "clip_model.visual.proj"
TEXT_POSITIONS = "clip_model.positional_embedding"
TEXT_TOKENS = "clip_model.token_embedding.weight"
ATTENTION_HEAD_WIDTH = 64
WORD_BITS = 62  # block numbers in one bit set


def scheme(raw: str = "raw") -> Column:
    return F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def _file_uri(path: Column) -> Column:
    """file: URI of an absolute path with . and .. folded and reserved characters escaped."""
    def fold(done: Column, step: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when((step == "") | (step == "."), done).when(step == "..", up).otherwise(
            F.concat(done, F.array(step))
        )

    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)
    # url_encode writes form encoding; URIs differ in the space, the asterisk and the tilde
    safe = F.transform(steps, lambda s: F.replace(
        F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
        F.lit("%7E"), F.lit("~"),
    ))
    return F.concat(F.lit("file:///"), F.array_join(safe, "/"))


def resolve_sources(sources: DataFrame, root: str = "/data") -> DataFrame:
    """uri, path and is_rtsp of raw source strings.

    file: URIs are decoded to a path; other schemes stay as they are, without a path;
    bare paths are rooted at ``root``.
    """
    raw = F.col("raw")
    kind = scheme("raw")
    # what follows file:, without an authority, query or fragment
    rest = F.regexp_extract(raw, r"^[A-Za-z]+:(?://[^/?#]*)?([^?#]*)", 1)
    decoded = F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    bare = F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), raw))
    path = F.when(kind == "file", decoded).when(kind == "", bare)
    return sources.withColumn("path", path).withColumns({
        "uri": F.when(F.col("path").isNull(), raw).otherwise(_file_uri(F.col("path"))),
        "is_rtsp": kind.isin("rtsp", "rtsps"),
    })


def codec_families(inventory: DataFrame, caps: str = "caps") -> DataFrame:
    """Streams with the way they are served; sources without a video stream are rejected."""
    low = F.lower(F.col(caps))

    def mentions(marks: Sequence[str]) -> Column:
        hit = low.contains(marks[0])
        for mark in marks[1:]:
            hit = hit | low.contains(mark)
        return hit

    family = F.when(mentions(H265_MARKS), "h265").when(mentions(H264_MARKS), "h264").otherwise("encode-h264")
    return inventory.filter(F.col(caps).isNotNull()).withColumn("family", family)


def input_sizes(sources: DataFrame, long_side: str = "long_side") -> DataFrame:
    size = model_input_size("src_w", "src_h", long_side)
    return sources.withColumn("_s", size).withColumns(
        {"input_w": F.col("_s.width"), "input_h": F.col("_s.height")}
    ).drop("_s")


def match_registry(
    requests: DataFrame,
    registry: DataFrame,
    request_keys: Sequence[str] = ("stem", "long_side", "src_w", "src_h"),
) -> DataFrame:
    """First registered model by name that fits each request, or NULLs.

    Model stem and long side must agree; requested long side and source sizes must
    agree or be absent from the entry. Both sides are reduced to distinct combinations
    before they meet, entries to the first name of theirs.
    """
    keys = list(request_keys)
    wanted = requests.select(*keys).distinct().alias("q")
    terms = ["stem", "long_side", "requested_long_side", "source_width", "source_height"]
    entry = F.struct("name", "model_width", "model_height")
    r = registry.groupBy(*terms).agg(F.min_by(entry, "name").alias("e")).select(*terms, "e.*").alias("r")

    def fits(entry: str, request: str) -> Column:
        return F.col(f"r.{entry}").isNull() | (F.col(f"r.{entry}") == F.col(f"q.{request}"))

    condition = (
        (F.col("r.stem") == F.col("q.stem")) & (F.col("r.long_side") == F.col("q.long_side"))
        & fits("requested_long_side", "long_side") & fits("source_width", "src_w")
        & fits("source_height", "src_h")
    )
    found = F.struct("r.name", "r.model_width", "r.model_height")
    best = wanted.join(r, condition).groupBy(*[F.col(f"q.{k}") for k in keys]).agg(
        F.min_by(found, F.col("r.name")).alias("_m")
    )
    known = F.col("_m.model_width").isNotNull() & F.col("_m.model_height").isNotNull()
    fallback = model_input_size("src_w", "src_h", "long_side")
    matched = requests.join(best, keys, "left").withColumn("_f", fallback)
    hit = F.col("_m").isNotNull()
    return matched.select(
        *requests.columns, F.col("_m.name").alias("model"),
        F.when(hit, F.when(known, F.col("_m.model_width").cast("bigint")).otherwise(F.col("_f.width"))).alias("input_w"),
        F.when(hit, F.when(known, F.col("_m.model_height").cast("bigint")).otherwise(F.col("_f.height"))).alias("input_h"),
    )


def missing_weights(checkpoint: DataFrame, heads: Sequence[str] = HEADS) -> DataFrame:
    """Required head tensors a checkpoint lacks. Each checkpoint keeps only its required keys."""
    required = [f"heads.{h}.{part}" for h in heads for part in ("weight", "bias")]
    present = checkpoint.groupBy("ckpt").agg(
        F.collect_set(F.when(F.col("key").isin(*required), F.col("key"))).alias("_have")
    )
    wanted = F.array(*[F.lit(k) for k in required])
    return present.select("ckpt", F.explode(F.array_except(wanted, "_have")).alias("key"))


def checkpoint_spec(checkpoint: DataFrame) -> DataFrame:
    """Model dimensions per checkpoint, from key names and tensor shapes (dim0, dim1, last dim)."""
    last = F.col("dim_last") if "dim_last" in checkpoint.columns else F.col("dim1")

    def block(prefix: str, pattern: str) -> Column:
        number = F.regexp_extract("key", pattern, 1)  # only of keys with the prefix
        return F.when(F.col("key").startswith(prefix), F.when(number != "", number.try_cast("bigint")))

    def dim(key: str, value: Column) -> Column:
        return F.max(F.when(F.col("key") == key, value))

    # block numbers are bits of a word; words of a checkpoint are few, so all of it is hash aggregation
    numbered = checkpoint.withColumns({"_v": block(VISUAL_PREFIX, VISUAL_BLOCK), "_t": block(TEXT_PREFIX, TEXT_BLOCK)})
    bit = lambda n: F.expr(f"shiftleft(1L, CAST({n} % {WORD_BITS} AS INT))")
    word = F.call_function("div", F.coalesce("_v", "_t"), F.lit(WORD_BITS))
    dims = {
        "_positions": dim(VISUAL_POSITIONS, F.col("dim0")), "patch_size": dim(VISUAL_CONV, last),
        "visual_width": dim(VISUAL_CONV, F.col("dim0")), "embedding_dim": dim(VISUAL_PROJECTION, F.col("dim1")),
        "context_length": dim(TEXT_POSITIONS, F.col("dim0")), "vocab_size": dim(TEXT_TOKENS, F.col("dim0")),
        "transformer_width": dim(TEXT_TOKENS, F.col("dim1")),
    }
    words = numbered.groupBy("ckpt", word.alias("_word")).agg(
        F.count("*").alias("_keys"), F.bit_or(bit("_v")).alias("_v"), F.bit_or(bit("_t")).alias("_t"),
        *[column.alias(name) for name, column in dims.items()],
    )
    layers = lambda c: F.coalesce(F.sum(F.bit_count(c)), F.lit(0)).cast("bigint")
    spec = words.groupBy("ckpt").agg(
        F.sum("_keys").alias("state_dict_keys"), layers("_v").alias("visual_layers"), layers("_t").alias("transformer_layers"),
        *[F.max(name).alias(name) for name in dims],
    )
    grid = F.rint(F.sqrt((F.col("_positions") - 1).cast("double"))).cast("int")
    per_head = F.lit(ATTENTION_HEAD_WIDTH)
    return spec.withColumn("visual_grid", grid).withColumns({
        "image_resolution": F.col("visual_grid") * F.col("patch_size"),
        "visual_heads": F.call_function("div", F.col("visual_width"), per_head).cast("int"),
        "transformer_heads": F.call_function("div", F.col("transformer_width"), per_head).cast("int"),
    }).drop("_positions")


def head_shapes(checkpoint: DataFrame, heads: Sequence[str] = HEADS) -> DataFrame:
    """Classes and feature width per checkpoint and head."""
    head = F.regexp_extract("key", r"^heads\.(.*)\.weight$", 1)
    return checkpoint.withColumn("head", head).filter(F.col("head").isin(*heads)).select(
        "ckpt", "head", F.col("dim0").alias("classes"), F.col("dim1").alias("in_features")
    )
