"""Relational prediction on Spark: labels, point-in-time features, models and explanations."""

from relpredict.operators.cutoffs import synthesize_many
from relpredict.operators.features import synthesize_at
from relpredict.operators.labels import build_labels, build_labels_many
from relpredict.operators.profile import discover
from relpredict.plans.pipeline import PredictionResult, ablation, fit_predict, given_metrics, score_given
from relpredict.schema import Database, declare
from relpredict.sources.tables import JdbcSource, load_folder, load_tables
from relpredict.task import FutureWindow, PredictiveTask, churn, demand, event_risk

__all__ = [
    "Database",
    "FutureWindow",
    "JdbcSource",
    "PredictionResult",
    "PredictiveTask",
    "ablation",
    "build_labels",
    "build_labels_many",
    "churn",
    "declare",
    "demand",
    "discover",
    "event_risk",
    "fit_predict",
    "load_folder",
    "load_tables",
    "given_metrics", "score_given",
    "synthesize_at",
    "synthesize_many",
]
