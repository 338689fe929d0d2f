"""Embedding providers and their use on a column (EMB1-EMB9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a provider gets at a time.
BATCH = 16


class Provider(Protocol):
    def embed_texts(self, texts: Sequence[str]) -> list[np.ndarray]: ...


def normalized(v: np.ndarray) -> np.ndarray:
    """EMB6: unit length; a zero vector stays."""
    v = np.asarray(v, np.float32)
    length = np.sqrt((v * v).sum(dtype=np.float32))
    return v / length if length > 0 else v


class Stub:
    """EMB5: deterministic vectors from hashes of 8-byte windows, for tests and where there is no model."""

    def __init__(self, dimension: int) -> None:
        if dimension <= 0:
            raise ValueError("dimension must be positive")
        self.dimension = dimension

    def embed_texts(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        out, data = np.zeros(self.dimension, np.float32), text.encode()
        if text.strip():
            for k in range(len(data) - 7):
                slot, sign, size = hashlib.sha256(data[k : k + 8] + k.to_bytes(8, "little")).digest()[:3]
                out[slot % self.dimension] += np.float32(-1 if sign & 1 else 1) * (np.float32(size) / np.float32(255))
        if not out.any():
            out[data[0] % self.dimension if text.strip() else 0] = 1
        return normalized(out)


class Onnx:
    """EMB3, EMB4: a local model folder with tokenizer.json and an ONNX file; opened once per worker."""

    def __init__(self, folder: str, dimension: int, threads: int = 4) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        self.dimension = dimension
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.enable_padding(pad_id=1, pad_token="<pad>")
        self.tokenizer.enable_truncation(512)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        from pathlib import Path

        file = next(p for p in (Path(folder, "model_quantized.onnx"), Path(folder, "model.onnx")) if p.exists())
        self.session = onnxruntime.InferenceSession(str(file), options)
        names = [x.name for x in self.session.get_outputs()]
        self.output = "dense_vecs" if "dense_vecs" in names else names[0]

    def embed_texts(self, texts: Sequence[str]) -> list[np.ndarray]:
        if not texts:
            return []
        found = self.tokenizer.encode_batch(list(texts))
        given = {"input_ids": np.array([x.ids for x in found], np.int64), "attention_mask": np.array([x.attention_mask for x in found], np.int64)}
        (out,) = self.session.run([self.output], given)
        rows = out[:, 0] if out.ndim == 3 else out.reshape(len(texts), -1)  # the first token stands for a sequence
        if not rows.size:
            raise ValueError(f"the model's output has shape {out.shape}")
        return [normalized(v[: self.dimension]) for v in rows]


PROVIDERS = {"stub": lambda c: Stub(c.dimension), "onnx": lambda c: Onnx(c.model, c.dimension, c.intra_threads)}


def provider_of(config) -> Provider:  # noqa: ANN001
    """EMB2."""
    if config.provider not in PROVIDERS:
        raise ValueError(f"no provider {config.provider!r}; there are {sorted(PROVIDERS)}")
    if config.dimension <= 0:
        raise ValueError("dimension must be positive")
    return PROVIDERS[config.provider](config)


def embed(text: Column, config) -> Column:  # noqa: ANN001
    """EMB7: vectors of a column, in order, in small batches; checks their dimension."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = provider_of(config)
        for texts in it:
            out: list[np.ndarray] = []
            for k in range(0, len(texts), BATCH):
                out += provider.embed_texts(texts.iloc[k : k + BATCH].tolist())
            if any(len(v) != config.dimension for v in out):
                raise ValueError(f"vectors must have {config.dimension} dimensions")
            yield pd.Series(out, index=texts.index)

    return run(text)
