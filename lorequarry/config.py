"""Settings with their defaults, from YAML in which ${NAME:default} stands for the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")
_DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}\Z")


def interpolated(value: Any) -> Any:
    """Variables replaced in all strings of a nested value; an unset one without default is empty."""
    if isinstance(value, dict):
        return {k: interpolated(v) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolated(v) for v in value]
    return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[2] or ""), value) if isinstance(value, str) else value


@dataclass(frozen=True)
class Domain:
    name: str
    directory: str
    enabled: bool = True
    profile: str = "hybrid_advanced"
    collection: str | None = None
    namespace: str | None = None


@dataclass(frozen=True)
class Settings:
    # The defaults of the engine.
    keyword_width: int = 20
    vector_width: int = 40
    rrf_constant: int = 60
    rrf_width: int = 10
    rerank_width: int = 5
    duplicate_threshold: float = 0.8
    quote_chars: int = 160
    child_max_tokens: int = 350
    child_min_tokens: int = 80
    overlap_tokens: int = 40
    similarity_threshold: float = 0.62
    vector_size: int = 512
    distance: str = "Cosine"
    embedding_model_id: str = "hashing-trigrams"
    embedding_revision: str = ""
    keep_versions: int = 2
    min_text_chars: int = 50
    max_upload_bytes: int = 52_428_800
    min_ocr_confidence: float = 60.0
    allow_rerank_fallback: bool = False
    allowed_extensions: tuple[str, ...] = (".md", ".txt", ".html", ".htm", ".docx", ".pdf", ".png", ".jpg", ".jpeg")
    knowledge_root: str = "knowledge"
    managed_root: str = "managed"
    index_root: str = "indexes"
    ingestion_root: str = "ingestion"
    domains: dict[str, Domain] = field(default_factory=dict)

    def domain(self, name: str) -> Domain:
        if name not in self.domains:
            raise ValueError(f"unknown domain: {name}")
        if not self.domains[name].enabled:
            raise ValueError(f"disabled domain: {name}")
        return self.domains[name]

    def chunking(self) -> dict[str, Any]:
        return {
            "child_max_tokens": self.child_max_tokens, "child_min_tokens": self.child_min_tokens,
            "overlap_tokens": self.overlap_tokens, "similarity_threshold": self.similarity_threshold,
        }


def load(path: str | Path) -> Settings:
    raw = interpolated(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    domains = {n: Domain(name=n, **{"directory": n} | (d or {})) for n, d in (raw.pop("domains", None) or {}).items()}
    known = {k: v for k, v in raw.items() if k in Settings.__dataclass_fields__}
    return Settings(**known, domains=domains)


def contained(root: str, name: str) -> str:
    """The folder of a domain below a root, or an error if the name could lead elsewhere."""
    if not _DOMAIN.match(name or ""):
        raise ValueError(f"invalid domain name: {name!r}")
    return f"{root.rstrip('/')}/{name}"


def knowledge_folder(settings: Settings, name: str) -> str:
    """An absolute directory or URL of a domain as it is, else one below the root."""
    d = settings.domain(name)
    return d.directory if re.match(r"/|[a-z][a-z0-9+.-]*:", d.directory) else f"{settings.knowledge_root.rstrip('/')}/{d.directory}"


def collection_of(settings: Settings, name: str) -> str:
    d = settings.domain(name)
    return d.collection or d.namespace or f"lore_{name}"
