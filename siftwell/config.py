"""Settings: models, profiles, tuning knobs and the settings file.

Environment variables win over the profile, and the profile over the defaults here. Nothing in this module
needs Spark, except ``listing``.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def env_int(name: str, default: int, least: int = 1) -> int:
    try:
        return max(least, int(os.environ[name]))
    except (KeyError, ValueError):
        return default


def env_float(name: str, default: float) -> float:
    try:
        return float(os.environ[name])
    except (KeyError, ValueError):
        return default


def env_bool(name: str, default: bool) -> bool:
    value = os.environ.get(name, "").strip().lower()
    return True if value in TRUE else False if value in FALSE else default


@dataclass(frozen=True)
class Model:
    key: str
    kind: str  # embedder or reranker
    billions: float
    ram_gb: float
    note: str = ""


MODELS = {
    m.key: m
    for m in (
        Model("hash-256", "embedder", 0.0, 0.1, "signed hashing of words, 256 dimensions"),
        Model("hash-1024", "embedder", 0.0, 0.1, "signed hashing of words, 1024 dimensions"),
        Model("overlap", "reranker", 0.0, 0.1, "weighted overlap of words"),
        Model("neutral", "reranker", 0.0, 0.0, "keeps the order"),
    )
}


@dataclass(frozen=True)
class Profile:
    name: str
    embedder: str
    reranker: str
    batch: int
    rerank_most: int
    ms_per_doc: int


PROFILES = {
    p.name: p
    for p in (
        Profile("fast", "hash-256", "overlap", 32, 12, 180),
        Profile("accurate", "hash-1024", "overlap", 4, 12, 220),
        Profile("precise", "hash-1024", "overlap", 2, 12, 280),
    )
}


@dataclass(frozen=True)
class Knobs:
    """How many candidates each step takes."""

    dense_k: int = 30
    sparse_k: int = 30
    recall_k: int = 30
    rrf_k: int = 60
    retrieve_k: int | None = None
    rerank_most: int = 30
    ms_per_doc: int = 250
    debounce_s: float = 2.5
    micro_batch: int = 10
    upsert_batch: int = 500
    regex_case_sensitive: bool = False

    @classmethod
    def resolve(cls, profile: Profile | None = None) -> Knobs:
        """From the environment (``SIFTWELL_`` and the name in capitals), then the profile, then the defaults."""
        base = {f.name: f.default for f in fields(cls)}
        if profile:
            base |= {"rerank_most": profile.rerank_most, "ms_per_doc": profile.ms_per_doc}
        out = {}
        for name, value in base.items():
            key = f"SIFTWELL_{name.upper()}"
            if isinstance(value, bool):
                out[name] = env_bool(key, value)
            elif isinstance(value, float):
                out[name] = env_float(key, value)
            elif value is None:
                out[name] = env_int(key, 1) if key in os.environ else None
            else:
                out[name] = env_int(key, value)
        return cls(**out)

    def candidates(self, n: int) -> int:
        """How many vectors a search for n results takes: the override, else 3n between 10 and 12, n at least."""
        return self.retrieve_k or max(10, min(3 * n, 12), n)


@dataclass
class Settings:
    embedder: str = "hash-256"
    reranker: str = "overlap"
    profile: str = "fast"
    extra: dict = field(default_factory=dict)


def settings_path() -> Path:
    return Path(os.environ.get("SIFTWELL_CONFIG", "~/.config/siftwell/config.json")).expanduser()


def load_settings(path: Path | None = None) -> Settings:
    """The settings file; what is missing or broken in it takes the default. ``model_key`` and ``model`` are former
    names of ``embedder``."""
    try:
        raw = json.loads((path or settings_path()).read_text())
    except (OSError, ValueError):
        return Settings()
    if not isinstance(raw, dict):
        return Settings()
    for former in ("model_key", "model"):
        if former in raw:
            raw.setdefault("embedder", raw.pop(former))
    known = {f.name for f in fields(Settings)}
    out = Settings(**{k: v for k, v in raw.items() if k in known})
    out.extra |= {k: v for k, v in raw.items() if k not in known}
    return out


def save_settings(settings: Settings, path: Path | None = None) -> None:
    """Written beside the file and moved into place."""
    target = path or settings_path()
    target.parent.mkdir(parents=True, exist_ok=True)
    temporary = target.with_suffix(".next")
    temporary.write_text(json.dumps(asdict(settings), indent=2, sort_keys=True))
    temporary.replace(target)


def resolve_model(key: str, kind: str) -> Model:
    """A registered model, or one named ``owner/name``, whose size is read off the name."""
    if key in MODELS:
        if MODELS[key].kind != kind:
            raise KeyError(f"{key} is no {kind}")
        return MODELS[key]
    if "/" in key:
        from siftwell.operators.embed import model_billions

        return Model(key, kind, model_billions(key) or 0.0, 0.0)
    raise KeyError(f"unknown {kind}: {key}")


def listing(spark, kind: str | None = None):
    """Registered models as a table."""
    rows = [asdict(m) for m in MODELS.values() if kind in (None, m.kind)]
    return spark.createDataFrame(rows, "key string, kind string, billions double, ram_gb double, note string")
