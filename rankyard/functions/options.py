"""Arguments of runs, checked before anything is read."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

# The keys of an embedding source, and what may stand beside one.
SOURCES = ("huggingface", "local", "ollama", "url")
MODIFIERS = ("revision", "download", "pooling", "queryPrefix", "docPrefix", "model", "apiKeyEnv")


def k_values(pool_size: int, top_k: int, ks: Sequence[int] = (1, 3, 5)) -> list[int]:
    """The cutoffs of one pool: the usual ones, the shortlist's and the pool's own, each once, none beyond the pool."""
    return [k for k in dict.fromkeys((*ks, top_k, pool_size)) if k <= pool_size]


def embedding(text: str | None) -> dict | str | None:
    """An embedding source: none, the path of a local model, or a JSON object that names exactly one source."""
    if not text:
        return None
    text = text.strip()
    if not text.startswith("{"):
        return text
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ValueError(f"the embedding is no JSON object: {e}") from None
    named = [k for k in SOURCES if k in found]
    if len(named) != 1:
        raise ValueError(f"the embedding names {len(named)} sources ({', '.join(named)}): exactly one of {', '.join(SOURCES)}")
    if unknown := [k for k in found if k not in SOURCES + MODIFIERS]:
        raise ValueError(f"the embedding has unknown keys: {', '.join(unknown)}")
    if "url" in found and not isinstance(found.get("model"), str):
        raise ValueError("an embedding of a url needs a model")
    return found


def embedding_label(spec: dict | str | None) -> str:
    """The name of an embedding in a run's version."""
    if spec is None or isinstance(spec, str):
        return spec or "default"
    return next((spec[k] for k in SOURCES if isinstance(spec.get(k), str)), "custom")


def summary_path(output: str) -> str:
    """Where a run's summary goes unless it is said: beside its output, which loses its suffix."""
    return os.path.splitext(output)[0] + "-summary.jsonl"
