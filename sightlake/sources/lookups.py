"""Small text and JSON inputs: class label files and model registry entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import DETECTOR_CLASSES
from ..functions.clock import integer_text
from ..schemas import REGISTRY_ENTRY
from ..skew import broadcast_if_small


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name): the 0-based line number is the class id."""
    text = spark.read.text(path, wholetext=True)
    trimmed = F.regexp_replace("value", r"\s+$", "")
    return text.select(F.posexplode(F.split(trimmed, r"\r?\n")).alias("class_id", "name"))


def detector_labels(spark: SparkSession) -> DataFrame:
    """The built-in detector classes as a table of fixed size."""
    names = F.array(*[F.lit(n) for n in DETECTOR_CLASSES])
    return spark.range(1).select(F.posexplode(names).alias("class_id", "name"))


def with_class_name(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Detections with their class name. A class list of ordinary size is broadcast."""
    dim = broadcast_if_small(labels.withColumnRenamed("name", "class_name"))
    return detections.join(dim, "class_id", "left")


def parse_registry(entries: DataFrame, json: str = "json") -> DataFrame:
    """Registry columns from JSON text; absent keys and invalid JSON give NULLs, never an error."""
    text_schema = ", ".join(f"{f.name} string" for f in REGISTRY_ENTRY.fields)
    parsed = entries.withColumn("_e", F.from_json(json, text_schema))
    kept = [c for c in entries.columns if c != json]
    return parsed.select(
        *kept, *[integer_text(f"_e.{f.name}").cast(f.dataType).alias(f.name) for f in REGISTRY_ENTRY.fields]
    )


def read_registry(spark: SparkSession, path: str, suffix: str = ".meta.json") -> DataFrame:
    """Registry entries of a folder, one JSON file each; ``name`` is the file name without suffix.

    Stem and requested long side are taken from names of the form stem_side_....
    """
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    named = files.select(
        F.regexp_replace("_metadata.file_name", F.lit(suffix.replace(".", r"\.") + "$"), F.lit("")).alias("name"),
        F.col("value").alias("json"),
    )
    pattern = r"^(.*?)_([0-9]+)_"
    return parse_registry(named).withColumns({
        "stem": F.regexp_extract("name", pattern, 1),
        "long_side": F.regexp_extract("name", pattern, 2).try_cast("int"),
    })
