"""Default settings. The values are fixed: they must equal the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

NORMAL = "normal"
DDOS = "ddos"

MIN_PACKETS = 10
DEFAULT_LIVE_WINDOW = 1000
CAPTURE_EXTENSIONS = ("pcap", "pcapng")


@dataclass(frozen=True)
class FeatureSettings:
    groups: tuple[str, ...] = ("basic", "time", "flow", "statistical")
    window_size: int = 100
    use_statistics: bool = True
    use_entropy: bool = True
    scaling: str = "standard_scaler"
    variance_threshold: float = 0.01


@dataclass(frozen=True)
class ForestSettings:
    n_estimators: int = 100
    max_depth: int = 20
    min_samples_leaf: int = 1
    bootstrap: bool = True
    class_weight: str | None = "balanced"
    random_state: int = 42


@dataclass(frozen=True)
class BoostSettings:
    n_estimators: int = 100
    max_depth: int = 10
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    random_state: int = 42


@dataclass(frozen=True)
class NetworkSettings:
    hidden_layers: tuple[int, ...] = (128, 64)
    max_iter: int = 200
    random_state: int = 42


@dataclass(frozen=True)
class ModelSettings:
    model_type: str = "random_forest"
    random_forest: ForestSettings = field(default_factory=ForestSettings)
    boosted_trees: BoostSettings = field(default_factory=BoostSettings)
    neural_network: NetworkSettings = field(default_factory=NetworkSettings)
    scaling: str = "standard_scaler"
    eval_split: float = 0.2
    cv_folds: int = 5
    scoring: tuple[str, ...] = ("accuracy", "precision", "recall", "f1", "roc_auc")
    seed: int = 42
