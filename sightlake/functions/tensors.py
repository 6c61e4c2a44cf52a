"""Tensor, probability and prediction expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..constants import (
    ANNOTATION_PREFIX, CHANNEL_MEAN, CHANNEL_SCALE, CHANNEL_STD, HEAD_CLASS_COUNTS, HEAD_LABELS, HEADS,
    MIN_NORM,
)

# fixed values: numpy layout of each tensor element type
ELEMENT_TYPES = {"FLOAT": "<f4", "HALF": "<f2", "INT32": "<i4", "INT8": "<i1"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def element_count(num_elements, dims) -> Column:
    product = F.aggregate(_col(dims), F.lit(1).cast("bigint"), lambda acc, d: acc * d)
    return F.when(_col(num_elements) > 0, _col(num_elements).cast("bigint")).otherwise(product)


def _decode_batch(data: pd.Series, dtype: pd.Series, count: pd.Series) -> pd.Series:
    out = [np.empty(0)] * len(data)
    usable = (data.notna() & (count > 0)).to_numpy()
    for name, layout in ELEMENT_TYPES.items():
        rows = np.flatnonzero(usable & (dtype == name).to_numpy())
        if not len(rows):
            continue
        size = np.dtype(layout).itemsize
        buffers = [data.iloc[i][: int(count.iloc[i]) * size] for i in rows]
        lengths = [len(b) // size for b in buffers]
        joined = b"".join(b[: n * size] for b, n in zip(buffers, lengths))
        values = np.frombuffer(joined, dtype=layout).astype("float64")
        for i, part in zip(rows, np.split(values, np.cumsum(lengths)[:-1])):
            out[i] = part
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_tensor(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(buffer, element type, element count) -> doubles; [] for unknown types and empty buffers."""
    for data, dtype, count in batches:
        yield _decode_batch(data, dtype, count)


def softmax(logits) -> Column:
    """Max-shifted softmax; an empty array stays empty."""
    def normalised(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda s: F.transform(exps, lambda x: x / s))

    logits = _col(logits)
    peak = F.array_max(logits)
    return let(let(peak, lambda p: F.transform(logits, lambda x: F.exp(x - p))), normalised)


def argmax(values) -> Column:
    """0-based position of the largest value; the first one wins a tie."""
    values = _col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def head_name(layer_name, layer_index) -> Column:
    """The layer's own name when it is a known head, else the head at its position, else NULL."""
    name = _col(layer_name)
    heads = F.array(*[F.lit(h) for h in HEADS])
    return F.when(name.isin(*HEADS), name).otherwise(F.get(heads, _col(layer_index)))


def class_count(head) -> Column:
    pairs = [x for h, n in HEAD_CLASS_COUNTS.items() for x in (F.lit(h), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), _col(head))


def prediction(logits, classes) -> Column:
    """struct<class_id, confidence, probabilities> from the first ``classes`` logits; NULL if none."""
    def pick(p: Column) -> Column:
        return F.struct(
            argmax(p).alias("class_id"), F.array_max(p).alias("confidence"), p.alias("probabilities")
        )

    used = F.slice(_col(logits), 1, classes)
    return F.when(F.size(used) > 0, let(softmax(used), pick))


def label_text(head, class_id) -> Column:
    """Label text where the head is a column; unmapped classes read head=classN."""
    head, class_id = _col(head), _col(class_id)
    known = [
        x for h, labels in HEAD_LABELS.items() for n, label in labels.items()
        for x in (F.lit(f"{h}/{n}"), F.lit(label))
    ]
    key = F.concat(head, F.lit("/"), class_id.cast("string"))
    fallback = F.concat(head, F.lit("=class"), class_id.cast("string"))
    return F.coalesce(F.try_element_at(F.create_map(*known), key), fallback)


def labels_of(predictions) -> Callable[[Column], Column]:
    """Function from head to label for a prediction map; absent heads read ''."""
    predictions = _col(predictions)

    def label(head: Column) -> Column:
        found = F.try_element_at(predictions, head)
        return F.when(found.isNull(), F.lit("")).otherwise(label_text(head, found["class_id"]))

    return label


def complete_predictions(predictions) -> Column:
    """Prediction map with defaults for missing members: class -1, confidence 0, no probabilities."""
    return F.transform_values(_col(predictions), lambda _, p: F.struct(
        F.coalesce(p["class_id"], F.lit(-1)).alias("class_id"),
        F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(p["probabilities"], F.array().cast("array<double>")).alias("probabilities"),
    ))


def annotations(predictions) -> Column:
    """array<struct<field_name, observation>> ordered by head name."""
    def annotate(entry: Column) -> Column:
        p = entry["value"]
        fallback = F.array(
            F.coalesce(p["class_id"].cast("double"), F.lit(-1.0)), F.coalesce(p["confidence"], F.lit(0.0))
        )
        observed = F.when(F.coalesce(F.size(p["probabilities"]), F.lit(0)) > 0, p["probabilities"])
        return F.struct(
            F.concat(F.lit(ANNOTATION_PREFIX), entry["key"]).alias("field_name"),
            F.coalesce(observed, fallback).alias("observation"),
        )

    return F.transform(F.array_sort(F.map_entries(_col(predictions))), annotate)


def normalize_channels(values, plane) -> Column:
    """Planar RGB bytes scaled to [0, 1], minus the channel mean, over the channel deviation."""
    mean = F.array(*[F.lit(m) for m in CHANNEL_MEAN])
    std = F.array(*[F.lit(s) for s in CHANNEL_STD])

    def one(x: Column, i: Column) -> Column:
        channel = F.floor(i / _col(plane)).cast("int")
        return (x * F.lit(CHANNEL_SCALE) - F.get(mean, channel)) / F.get(std, channel)

    return F.transform(_col(values), one)


def l2_normalize(values) -> Column:
    values = _col(values)
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)
    norm = F.greatest(F.sqrt(squares), F.lit(MIN_NORM))
    return let(norm, lambda n: F.transform(values, lambda x: x / n))
