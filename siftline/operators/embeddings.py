"""Vectors of texts: known models, a pluggable encoder, and the built-in hash vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.errors import BadQuery, ModelUnavailable
from siftline.functions import vectors as V


@dataclass(frozen=True)
class Model:
    name: str
    dim: int
    document_prefix: str = ""
    query_prefix: str = ""


# Models, their vector lengths and prefixes, and their longer names.
MODELS = {
    "minilm": Model("minilm", 384),
    "nomic": Model("nomic", 768, "search_document: ", "search_query: "),
    "nemotron": Model("nemotron", 2048, "passage: ", "query: "),
}
ALIASES = {"all-minilm-l6-v2": "minilm", "nomic-embed-text-v1.5": "nomic", "llama-nemotron-embed-vl-1b-v2": "nemotron"}


def model_of(name: str | None, dim: int | None = None) -> Model:
    """A known model by either name, case aside; ``custom`` takes the given length; anything else is minilm."""
    low = (name or "").lower()
    if low == "custom":
        if not dim or dim < 1:
            raise ModelUnavailable("a custom model needs its vector length")
        return Model("custom", dim)
    return MODELS.get(ALIASES.get(low, low), MODELS["minilm"])


# Takes the texts of a batch, gives a matrix with a row a text. It is made in the worker by a factory, once a task.
Encoder = Callable[[list[str]], np.ndarray]


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean over the tokens (texts x tokens x length) whose mask is 1; zero where none is."""
    m = (mask == 1).astype(np.float32)[..., None]
    n = m.sum(axis=1)
    return (hidden * m).sum(axis=1) / np.where(n > 0, n, 1)


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def embedded(texts: DataFrame, text: str, model: Model, query: bool = False, encoder: Callable[[], Encoder] | None = None, batch: int = 32, out: str = "embedding") -> DataFrame:
    """The rows with a vector of ``text``, by an encoder or, without one, by hashing.

    A null text has a null vector; texts the encoder fails on have the zero vector.
    """
    prefix = model.query_prefix if query else model.document_prefix
    if encoder is None:
        return texts.withColumn(out, F.when(F.col(text).isNotNull(), V.hash_embedding(F.col(text), model.dim, prefix)))
    if batch < 1:
        raise BadQuery("a batch holds at least one text")
    names = [c for c in texts.columns if c != out]
    at = names.index(text)
    schema = texts.select(*names).withColumn(out, F.lit(None).cast("array<float>")).schema

    def run(batches):
        encode = encoder()
        for b in batches:
            values = b.column(at).to_pylist()
            filled = [i for i, v in enumerate(values) if v is not None]
            vectors: list = [None] * len(values)
            for lo in range(0, len(filled), batch):
                some = filled[lo : lo + batch]
                try:
                    made = normalised(np.asarray(encode([prefix + values[i] for i in some]), np.float32))
                except Exception:  # noqa: BLE001 - one batch that fails must not end the job
                    made = np.zeros((len(some), model.dim), np.float32)
                if made.shape != (len(some), model.dim):
                    raise ModelUnavailable(f"{model.name} gave vectors of shape {made.shape}")
                for i, v in zip(some, made, strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, out])

    return texts.select(*names).mapInArrow(run, schema)


def best_batch(cores: int, device: str | None = None) -> int:
    """Texts a batch: by accelerator, else by cores."""
    if device in ("cuda", "coreml"):
        return {"cuda": 128, "coreml": 64}[device]
    return 16 if cores <= 2 else 32 if cores <= 4 else 48 if cores <= 8 else 64


def batch_statistics(items: DataFrame, size: int, seconds: float | None = None) -> DataFrame:
    """(items, batches, items_per_second) of work done in batches of ``size``; without a time the rate is null."""
    if size < 1:
        raise BadQuery("a batch holds at least one item")
    rate = F.lit(None).cast("double") if not seconds or seconds <= 0 else F.col("items") / F.lit(float(seconds))
    return items.agg(F.count("*").alias("items")).select("items", F.ceil(F.col("items") / size).alias("batches"), rate.alias("items_per_second"))
