"""Embedding providers. Each is loaded once in a worker process."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Protocol

import numpy as np
import xxhash

from vellumine.plans.config import EmbeddingModel


class Embedder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class MockEmbedder:
    """Vectors from hashes of the text: hermetic, and equal for equal texts."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        rounds = -(-self.dimension // 2)
        words = np.array([[xxhash.xxh3_64_intdigest(x.encode("utf-8"), seed=c) for c in range(rounds)] for x in texts], np.uint64).reshape(len(texts), rounds)
        halves = np.stack([words & np.uint64(0xFFFFFFFF), words >> np.uint64(32)], axis=2).reshape(len(texts), 2 * rounds)
        return (halves[:, : self.dimension].astype(np.float32) / np.float32(0xFFFFFFFF) - np.float32(0.5)).astype(np.float32)


class StaticEmbedder:
    """Mean of token vectors: a folder with ``tokenizer.json`` and ``vectors.npy``."""

    def __init__(self, folder: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.vectors = np.load(f"{folder}/vectors.npy", mmap_mode="r")
        self.dimension = self.vectors.shape[1]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, x in enumerate(self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids = [k for k in x.ids if k < len(self.vectors)]
            if ids:
                out[i] = np.asarray(self.vectors[ids], np.float32).mean(axis=0)
        return out


def hub_folder(model: str, hub: str | None = None) -> Path:
    """Where a hub's cache keeps a model."""
    return Path(hub or os.environ.get("HF_HUB_CACHE") or Path.home() / ".cache" / "huggingface" / "hub") / f"models--{model.replace('/', '--')}"


def cached_revision(model: str, hub: str | None = None) -> str | None:
    """The revision of a model that a hub's cache folder holds: the one that its main branch names, else the newest."""
    folder = hub_folder(model, hub)
    named = folder / "refs" / "main"
    held = [x for x in (folder / "snapshots").iterdir() if x.is_dir()] if (folder / "snapshots").is_dir() else []
    if named.is_file() and (wanted := named.read_text(encoding="utf-8").strip()) in {x.name for x in held}:
        return wanted
    return max(held, key=lambda x: (x.stat().st_mtime, x.name)).name if held else None


_LOADED: dict[tuple, Embedder] = {}


def load_embedder(model: EmbeddingModel) -> Embedder:
    """``mock`` (its name may end in ``-<dimension>``), ``static`` (its name is a folder) or ``hub`` (a model in a hub's cache)."""
    key = (model.provider, model.name, model.revision)
    if key not in _LOADED:
        if model.provider == "mock":
            tail = model.name.rsplit("-", 1)[-1]
            _LOADED[key] = MockEmbedder(int(tail) if tail.isdigit() else 64)
        elif model.provider == "static":
            _LOADED[key] = StaticEmbedder(model.name)
        elif model.provider == "hub":
            revision = model.revision or cached_revision(model.name)
            if revision is None:
                raise ValueError(f"no revision of '{model.name}' is cached")
            _LOADED[key] = StaticEmbedder(str(hub_folder(model.name) / "snapshots" / revision))
        else:
            raise ValueError(f"unknown embedding provider '{model.provider}'")
    return _LOADED[key]
