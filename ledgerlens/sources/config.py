"""Run configuration: typed defaults overridden by a nested dict or a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class DataConfig:
    max_training_rows: int = 1_000_000
    test_size: float = 0.2
    random_state: int = 42
    start_row: int = 0
    target_fraud_ratio: float = 0.0


@dataclass
class SamplingConfig:
    strategy: str = "hybrid"


@dataclass
class PreprocessingConfig:
    scaling_method: str = "robust"
    feature_selection: bool = True
    variance_threshold: float = 0.01
    information: str = "bins"  # "neighbours": the nearest-neighbour estimate
    fit_on: str = "train"  # "all" fits on train and test rows together


@dataclass
class ImbalanceConfig:
    method: str = "auto"
    sampling_strategy: float = 0.3


@dataclass
class ModelsConfig:
    candidates: list | None = None
    build_ensemble: bool = True
    small: bool = False


@dataclass
class TuningConfig:
    method: str = "random"
    n_iter: int = 50
    cv_folds: int = 5


@dataclass
class EvaluationConfig:
    shap_sample_size: int = 1000


@dataclass
class RunConfig:
    data: DataConfig = field(default_factory=DataConfig)
    sampling: SamplingConfig = field(default_factory=SamplingConfig)
    preprocessing: PreprocessingConfig = field(default_factory=PreprocessingConfig)
    imbalance: ImbalanceConfig = field(default_factory=ImbalanceConfig)
    models: ModelsConfig = field(default_factory=ModelsConfig)
    tuning: TuningConfig = field(default_factory=TuningConfig)
    evaluation: EvaluationConfig = field(default_factory=EvaluationConfig)


def configured(values: dict | None = None) -> RunConfig:
    """Defaults with the known keys of ``values``; keys nobody reads are ignored."""
    return _override(RunConfig(), values or {})


def _override(target, values: dict):
    for f in fields(target):
        if f.name not in values or values[f.name] is None:
            continue
        current = getattr(target, f.name)
        setattr(target, f.name, _override(current, values[f.name]) if is_dataclass(current) else values[f.name])
    return target


def load_config(path: str) -> RunConfig:
    import yaml

    with open(path) as handle:
        return configured(yaml.safe_load(handle))
