"""Configuration of an index, with validation: wrong keys and values raise."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

REBUILDS = ("no_rebuild", "basic_rebuild", "greedy_rebuild")


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class TrainParams:
    threshold_samples: int = 1000
    batch_size: int = 256
    epochs: int = 3
    max_iters: int = 10
    retrain_strategy: str = "no_retrain"


@dataclass(frozen=True)
class IndexConfig:
    buffer_size: int = 5000
    bucket_size: int = 5000
    input_shape: int = 768
    arity: int = 3
    distance_fn: str = "dot"
    rebuild_strategy: str = "no_rebuild"
    delete_method: str = "oid_to_bucket"
    layers: tuple[tuple[str, int], ...] = (("linear", 128), ("relu", 0))
    train: TrainParams = field(default_factory=TrainParams)
    quantize: bool = False
    half: bool = False
    seed: int = 0
    cold_storage_dir: str | None = None
    cold_threshold_level: int | None = None
    cold_cache_size_bytes: int = 0

    def __post_init__(self):
        for name in ("buffer_size", "bucket_size", "input_shape"):
            if getattr(self, name) < 1:
                raise ConfigError(f"{name} must be positive")
        if self.arity < 2:
            raise ConfigError("arity must be at least 2")
        if self.distance_fn not in ("dot", "l2"):
            raise ConfigError(f"unknown distance_fn {self.distance_fn!r}")
        if self.rebuild_strategy not in REBUILDS:
            raise ConfigError(f"unknown rebuild strategy {self.rebuild_strategy!r}")
        if self.delete_method != "oid_to_bucket":
            raise ConfigError(f"unknown delete_method {self.delete_method!r}")
        if self.train.retrain_strategy not in ("no_retrain", "from_scratch"):
            raise ConfigError(f"unknown retrain strategy {self.train.retrain_strategy!r}")
        if any(kind not in ("linear", "relu") for kind, _ in self.layers):
            raise ConfigError("layers are linear or relu")
        if self.buffer_size > self.arity * self.bucket_size:
            raise ConfigError("the buffer must fit into the first level")

    def n_buckets(self, level: int) -> int:
        return self.arity ** (level + 1)

    def capacity(self, level: int) -> int:
        return self.n_buckets(level) * self.bucket_size

    def with_(self, **changes: Any) -> IndexConfig:
        return replace(self, **changes)


def _strategy(value: Any) -> str:
    if isinstance(value, str):
        kind, _, rebuild = value.partition(":")
    elif isinstance(value, dict):
        kind, rebuild = value.get("type", ""), value.get("rebuild_strategy", "no_rebuild")
    else:
        raise ConfigError("compaction_strategy must be text or a mapping")
    if kind != "bentley_saxe":
        raise ConfigError(f"unknown compaction strategy {kind!r}")
    return rebuild or "no_rebuild"


def _known(data: dict, names: set[str], where: str) -> None:
    if extra := set(data) - names:
        raise ConfigError(f"unknown keys in {where}: {', '.join(sorted(extra))}")


def from_dict(data: dict[str, Any]) -> IndexConfig:
    """The nested form (levels.model.train_params and so on)."""
    own = {f.name for f in fields(IndexConfig)} - {"layers", "train", "rebuild_strategy", "bucket_size"}
    _known(data, own | {"compaction_strategy", "levels", "device"}, "the configuration")
    if data.get("device", "cpu") != "cpu":
        raise ConfigError("only the cpu is used")
    out = {k: v for k, v in data.items() if k in own}
    if "compaction_strategy" in data:
        out["rebuild_strategy"] = _strategy(data["compaction_strategy"])
    levels = data.get("levels", {})
    _known(levels, {"bucket_size", "model"}, "levels")
    if "bucket_size" in levels:
        out["bucket_size"] = levels["bucket_size"]
    model = levels.get("model", {})
    _known(model, {"layers", "train_params", "quantize", "seed", "weights_path"}, "levels.model")
    if model.get("weights_path") is not None:
        raise ConfigError("weights_path: routers are saved and loaded with their index")
    if "layers" in model:
        out["layers"] = tuple((x["type"], int(x.get("value", 0))) for x in model["layers"])
    out |= {k: model[k] for k in ("quantize", "seed") if k in model}
    train = model.get("train_params", {})
    _known(train, {f.name for f in fields(TrainParams)}, "train_params")
    out["train"] = TrainParams(**train)
    for f in fields(IndexConfig):
        if f.name in out and f.type == "int" and not (isinstance(out[f.name], int) and not isinstance(out[f.name], bool)):
            raise ConfigError(f"{f.name} must be a whole number")
    return IndexConfig(**out)


def from_yaml(path: str) -> IndexConfig:
    import yaml

    with open(path) as f:
        return from_dict(yaml.safe_load(f) or {})


def to_dict(config: IndexConfig) -> dict[str, Any]:
    """The nested form, as from_dict reads it."""
    model = {"layers": [{"type": k, "value": n} for k, n in config.layers], "train_params": asdict(config.train), "quantize": config.quantize, "seed": config.seed}
    out = {f.name: getattr(config, f.name) for f in fields(config) if f.name not in ("layers", "train", "rebuild_strategy", "bucket_size", "quantize", "seed")}
    return {**out, "compaction_strategy": {"type": "bentley_saxe", "rebuild_strategy": config.rebuild_strategy}, "levels": {"bucket_size": config.bucket_size, "model": model}}


def to_yaml(config: IndexConfig) -> str:
    import yaml

    return yaml.safe_dump(to_dict(config), sort_keys=False)
