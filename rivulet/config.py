"""Experiment configuration; unknown YAML keys are kept in ``extra``."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import yaml


@dataclass(frozen=True)
class Config:
    """All knobs of an experiment with their defaults."""

    dataset_name: str = "synthetic_debug"
    synthetic_n: int = 300
    label_col: str = "label"
    type_col: str = "type"
    feature_policy: str = "no_raw_ip_port"
    #: "cpu" standardises with the population deviation and balances classes; "gpu" does neither.
    semantics: str = "cpu"
    split_strategy: str = "random_stratified"
    group_cols: tuple[str, ...] = ()
    timestamp_col: str = "timestamp"
    timestamp_policy: str = "keep"
    timestamp_unit: str = "auto"
    temporal_bucket_freq: str | None = "1s"
    service_policy: str = "keep"
    test_size: float = 0.25
    val_size: float = 0.20
    svd_components: int = 8
    onehot_min_frequency: int = 1
    max_categories_per_col: int = 64
    log1p_numeric: bool = True
    log1p_columns: tuple[str, ...] | None = None
    selected_k: int = 3
    cluster_batch_size: int = 64
    cluster_n_init: int = 3
    cluster_max_iter: int = 50
    silhouette_sample_size: int = 200
    export_cluster_assignments: bool = True
    representative_strategy: str = "full"
    use_representatives_for_supervised: bool = False
    representatives_per_cluster: int = 20
    boundary_per_cluster: int = 5
    targets: tuple[str, ...] = ("label",)
    random_forest_estimators: int = 100
    random_forest_max_depth: int = 30
    random_state: int = 42
    extra: dict = field(default_factory=dict, hash=False)

    @property
    def group_tolerance(self) -> float:
        return float(self.extra.get("group_split_tolerance", 0.02))

    @property
    def group_candidates(self) -> int:
        return int(self.extra.get("group_split_candidates", 16))

    @property
    def min_class_support(self) -> int:
        return int(self.extra.get("split_min_class_support", 1))

    @property
    def small_support(self) -> int:
        return int(self.extra.get("split_small_support_threshold", 30))

    def validate(self) -> Config:
        """Raise ValueError on split parameters out of range."""
        if not (0 < self.test_size < 1 and 0 < self.val_size < 1):
            raise ValueError("test_size and val_size must lie between 0 and 1")
        if not 0 <= self.group_tolerance < 1 or self.group_candidates < 1 or self.min_class_support < 1:
            raise ValueError("invalid split search parameters")
        return self

    def goals(self) -> dict[str, float]:
        """Shares of train, val and test; val_size is a share of what test leaves."""
        rest = 1 - self.test_size
        return {"train": rest * (1 - self.val_size), "val": rest * self.val_size, "test": self.test_size}

    def as_dict(self) -> dict:
        return asdict(self)


def from_mapping(values: dict) -> Config:
    known = {f.name for f in fields(Config)} - {"extra"}
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
    return Config(**own, extra={k: v for k, v in values.items() if k not in known and k != "extra"} | dict(values.get("extra") or {}))


def load(path: str | Path) -> Config:
    return from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def require(cfg: Config, frozen: dict) -> None:
    """ValueError unless the configuration has these values; names may be keys of extra."""
    own = cfg.as_dict()
    differ = {k: (own.get(k, cfg.extra.get(k)), v) for k, v in frozen.items() if _plain(own.get(k, cfg.extra.get(k))) != _plain(v)}
    if differ:
        raise ValueError("the configuration differs from the frozen one: " + ", ".join(f"{k}={a!r}, not {b!r}" for k, (a, b) in sorted(differ.items())))


def _plain(v: object) -> object:
    return list(v) if isinstance(v, tuple) else v
