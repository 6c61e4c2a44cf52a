"""From raw tensors to per-object prediction maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

from ..constants import ASSESS_BATCH, ASSESSOR_ID, HEAD_CLASS_COUNTS, HEADS
from ..functions.tensors import class_count, head_name, prediction

OBJECT_KEYS = ("stream_id", "frame", "object_id")


def predict_objects(
    tensors: DataFrame,
    keys: Sequence[str] = OBJECT_KEYS,
    producer_id: int | None = ASSESSOR_ID,
) -> DataFrame:
    """One row per object with ``predictions``: map<head, struct<class_id, confidence, probabilities>>.

    Per head the highest layer index with logits wins. That choice is an aggregate
    combined before the shuffle, so an object with any number of tensors ships at
    most one array per head and task. Objects without a usable head give no row.
    """
    if producer_id is not None and "producer_id" in tensors.columns:
        tensors = tensors.filter(F.col("producer_id") == producer_id)
    named = tensors.select(
        *keys, "layer_index", "logits", head_name("layer_name", "layer_index").alias("_head")
    ).filter(F.col("_head").isNotNull() & (F.size("logits") > 0))
    chosen = named.groupBy(*keys).agg(*[
        F.max_by("logits", F.when(F.col("_head") == head, F.col("layer_index"))).alias(f"_h{i}")
        for i, head in enumerate(HEADS)
    ])
    heads = F.array(*[
        F.struct(F.lit(head).alias("key"), F.lit(classes).alias("n"), F.col(f"_h{i}").alias("logits"))
        for i, (head, classes) in enumerate(HEAD_CLASS_COUNTS.items())
    ])
    entries = F.transform(
        F.filter(heads, lambda h: h["logits"].isNotNull()),
        lambda h: F.struct(h["key"].alias("key"), prediction(h["logits"], h["n"]).alias("value")),
    )
    return chosen.select(*keys, F.map_from_entries(entries).alias("predictions"))


def explode_heads(predicted: DataFrame, keys: Sequence[str] = OBJECT_KEYS) -> DataFrame:
    """One row per object and head."""
    return predicted.select(*keys, F.explode("predictions").alias("head", "p")).select(
        *keys, "head", "p.class_id", "p.confidence", "p.probabilities"
    )


def resolve_heads(tensors: DataFrame) -> DataFrame:
    """Tensors with their ``head`` and ``n_classes``; tensors of no known head are dropped."""
    resolved = tensors.withColumn("head", head_name("layer_name", "layer_index"))
    return resolved.filter(F.col("head").isNotNull()).withColumn("n_classes", class_count("head"))


class HeadWeights:
    """Linear heads over one feature vector. Shapes are checked against the head catalogue."""

    def __init__(self, weights: Mapping[str, np.ndarray], biases: Mapping[str, np.ndarray]):
        missing = [h for h in HEADS if h not in weights or h not in biases]
        if missing:
            raise KeyError(f"missing head weights: {', '.join(missing)}")
        for head, classes in HEAD_CLASS_COUNTS.items():
            if len(weights[head]) != classes or len(biases[head]) != classes:
                raise ValueError(f"{head}: expected {classes} classes, got {len(weights[head])}")
        self.matrix = np.vstack([np.asarray(weights[h], dtype="float64") for h in HEADS])
        self.bias = np.concatenate([np.asarray(biases[h], dtype="float64") for h in HEADS])

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return features.astype("float64") @ self.matrix.T + self.bias


def split_heads(df: DataFrame, scores: str, keys: Sequence[str]) -> DataFrame:
    """Concatenated head scores to rows in tensor form (layer_index, layer_name, logits)."""
    layers, start = [], 1
    for index, (head, classes) in enumerate(HEAD_CLASS_COUNTS.items()):
        layers.append(F.struct(
            F.lit(index).alias("layer_index"), F.lit(head).alias("layer_name"),
            F.slice(scores, start, classes).alias("logits"),
        ))
        start += classes
    return df.select(*keys, F.inline(F.array(*layers)))


def score_heads(
    df: DataFrame, features: str, weights: HeadWeights, keys: Sequence[str]
) -> DataFrame:
    """W·f + b for every head. The weights have the fixed size of the head catalogue times
    the feature width and travel with the function; rows are scored in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(weights(np.stack(batch.to_numpy()))) if len(batch) else [])

    return split_heads(df.select(*keys, scores(features).alias("_scores")), "_scores", keys)


def infer(
    df: DataFrame,
    features: str,
    load_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    width: int,
    keys: Sequence[str],
    batch_size: int = ASSESS_BATCH,
) -> DataFrame:
    """Run a user-supplied model in batches; ``load_model`` runs once per Python worker."""
    model = predict_batch_udf(
        load_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return split_heads(df.select(*keys, model(features).alias("_scores")), "_scores", keys)
