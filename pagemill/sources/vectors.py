"""Vectors of texts by an encoder that the caller gives."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], list[list[float]]]
#: Models that this worker has loaded, by name and loader.
_LOADED: dict[tuple[str, str, str], Encode] = {}


@dataclass(frozen=True)
class Encoder:
    """A model by name: load() makes it, once a worker for each name and loader, and gives a function from texts to
    vectors. `batch` texts go to it at a time."""

    name: str
    load: Callable[[], Encode]
    batch: int = 64

    def __call__(self, texts: list[str]) -> tuple[list[list[float] | None], list[str | None]]:
        """A vector or an error for each text. A batch that fails is halved until the text that fails stands
        alone, so it costs no other its vector."""
        vectors: list[list[float] | None] = []
        errors: list[str | None] = []
        parts = [texts[i : i + self.batch] for i in range(0, len(texts), self.batch)][::-1]
        while parts:
            own = parts.pop()
            try:
                key = (self.name, self.load.__module__, self.load.__qualname__)
                if key not in _LOADED:
                    _LOADED[key] = self.load()
                found = [list(map(float, v)) for v in _LOADED[key](own)]
                if len(found) != len(own):
                    raise ValueError(f"{len(found)} vectors for {len(own)} texts")
                if not all(math.isfinite(x) for v in found for x in v):
                    raise ValueError("a component that isn't finite")
            except Exception as e:  # noqa: BLE001 - any failure of a model is a row's error
                if len(own) > 1:
                    half = len(own) // 2
                    parts += [own[half:], own[:half]]
                    continue
                found, message = [None], f"{type(e).__name__}: {e}"
                errors.append(message)
            else:
                errors += [None] * len(own)
            vectors += found
        return vectors, errors


def encoded(rows: DataFrame, text: str, encoder: Encoder) -> DataFrame:
    """The rows' other columns with vector and error, one of which is null. A null text is an empty one. No
    failure of the model fails a task."""
    others = [c for c in rows.columns if c != text]

    def run(batches):
        for batch in batches:
            vectors, errors = encoder([t or "" for t in batch.column("_text").to_pylist()])
            own = [batch.column(f"k{i}") for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*(f"k{i}" for i in range(len(others))), "vector", "error"])

    named = rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(others)), F.col(text).cast("string").alias("_text"))
    kinds = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(named.drop("_text").schema)]
    out = named.mapInArrow(run, ", ".join([*kinds, "vector array<float>", "error string"]))
    return out.toDF(*others, "vector", "error")
