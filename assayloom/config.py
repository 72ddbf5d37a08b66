"""Run settings: a TOML file for the analysis, options for the run; both frozen, both checked."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any

# The names of settings and options, their defaults, and the values they can have are those that configuration files of
# this kind of analysis use, so that such files can be read.

MODELS = ("xgboost", "balanced_random_forest", "random_forest")
SELECTIONS = ("mutual_information", "multisurf", "univariate", "boruta")
AUGMENTATIONS = ("none", "kde", "kde_balanced", "smote_balanced", "smote_tomek", "smote_enn", "ratio")
STRATEGIES = ("mar", "mnar", "mixed")
TESTS = ("ttest_independent",)
ADDITIONS = ("feature_importance", "model_performance")
IMPORTANCES = ("shap", "eject_shap", "tree_importance", "mutual_information", "permutation_importance")


def _known(name: str, value: object, values: tuple[str, ...]) -> None:
    if value not in values:
        raise ValueError(f"{name}: {value!r} is none of {', '.join(values)}")


@dataclass(frozen=True)
class Stats:
    pvalue_thresh: float = 0.05
    power: float = 0.95
    alpha: float = 0.05


@dataclass(frozen=True)
class Addition:
    method: str = "feature_importance"
    importance_selection: str = "shap"

    def __post_init__(self) -> None:
        _known("addition.method", self.method, ADDITIONS)
        _known("addition.importance_selection", self.importance_selection, IMPORTANCES)


@dataclass(frozen=True)
class Selection:
    multisurf_cross_validation_splits: int = 50
    cross_validation_splits: int = 2
    cross_validation_repeats: int = 25
    number_of_mi_features: float | int | str = 0.035
    number_of_features: int = 30
    addition: Addition = field(default_factory=Addition)


@dataclass(frozen=True)
class Smote:
    new_cancer_ratio: float = 0.5
    new_total_samples: int = 0


@dataclass(frozen=True)
class Augmentation:
    smote: Smote = field(default_factory=Smote)


@dataclass(frozen=True)
class Search:
    scorer: tuple[str, ...] | str = ("mcc", "sens@99spec")
    trials: int = 300
    before_feature_selection: bool = False
    after_rfa: bool = True
    before_validation: bool = False


@dataclass(frozen=True)
class Optimization:
    optuna: Search = field(default_factory=Search)  # the section keeps the name that configuration files have


@dataclass(frozen=True)
class Settings:
    random_state: int = 0
    sub_cohort: str = "all"
    scale_transform: bool = True
    pca: bool = False
    stats: Stats = field(default_factory=Stats)
    feature_selection: Selection = field(default_factory=Selection)
    augmentation: Augmentation = field(default_factory=Augmentation)
    optimization: Optimization = field(default_factory=Optimization)


@dataclass(frozen=True)
class Options:
    input_path: str | None = None
    output_path: str | None = None
    stats: str = "ttest_independent"
    s3_bucket: str | None = None
    s3_input_path: str | None = None
    s3_output_path: str | None = None
    s3_labelled_cohort_key: str | None = None
    imputation_strategy: str = "mar"
    use_batch_corrected: bool = False
    model: str = "xgboost"
    feature_selection: str = "mutual_information"
    augmentation: str = "none"
    dry_run: bool = False
    rec_feat_add: bool = True
    use_full_data: bool = False
    prepare_data: bool = False
    best_pipeline: str = ""

    def __post_init__(self) -> None:
        for name, known in (("model", MODELS), ("feature_selection", SELECTIONS), ("augmentation", AUGMENTATIONS), ("imputation_strategy", STRATEGIES), ("stats", TESTS)):
            _known(name, getattr(self, name), known)
        local, remote = self.input_path is not None, self.s3_bucket is not None and self.s3_input_path is not None
        if local == remote:
            raise ValueError("give either input_path, or both s3_bucket and s3_input_path")

    @property
    def source(self) -> str:
        """Where the data lie: a local path or an object-store URI."""
        return self.input_path if self.input_path is not None else f"s3a://{self.s3_bucket}/{self.s3_input_path}"

    @property
    def target(self) -> str:
        if self.output_path:
            return self.output_path
        return f"s3a://{self.s3_bucket}/{self.s3_output_path}" if self.s3_output_path else f"{self.source.rstrip('/')}/results"


def _fill(kind: type, data: dict[str, Any], at: str = "") -> Any:
    known = {f.name: f for f in fields(kind)}
    if odd := sorted(set(data) - set(known)):
        raise ValueError(f"unknown setting {at}{odd[0]}")
    values = {}
    for name, v in data.items():
        default = getattr(kind(), name)
        values[name] = _fill(type(default), v, f"{at}{name}.") if is_dataclass(default) else tuple(v) if isinstance(v, list) else v
    return kind(**values)


def parse_settings(text: str) -> Settings:
    """From TOML text; what it does not name keeps its default, what it names wrongly raises."""
    return _fill(Settings, tomllib.loads(text))


def read_settings(path: str) -> Settings:
    with open(path, encoding="utf-8") as f:
        return parse_settings(f.read())


def as_dict(config: Any) -> dict[str, Any]:
    return asdict(config)


def headers(config: Any) -> list[str]:
    """The sections of a configuration."""
    return [f.name for f in fields(config) if is_dataclass(getattr(config, f.name))]


def differences(a: dict, b: dict, at: str = "") -> dict[str, tuple]:
    """Settings that differ, by dotted name."""
    out = {}
    for k in sorted(set(a) | set(b)):
        x, y = a.get(k), b.get(k)
        if isinstance(x, dict) and isinstance(y, dict):
            out |= differences(x, y, f"{at}{k}.")
        elif x != y:
            out[f"{at}{k}"] = (x, y)
    return out


def switched_on(config: Any) -> list[str]:
    """Names of the settings that are true."""
    return [f.name for f in fields(config) if getattr(config, f.name) is True]
