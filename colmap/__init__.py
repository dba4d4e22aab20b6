"""Column mapping and standardization of many tables on Spark."""

from colmap.plans.evaluation import (
    evaluate,
    evaluate_dataset,
    evaluate_spec,
    evaluate_spec_dataset,
    run_evaluation,
    run_evaluation_specs,
)
from colmap.plans.methods import (
    embedding_method,
    function_method,
    keyword_method,
    method_registry,
    model_method,
)
from colmap.plans.standardize import (
    baseline_embedding_match,
    baseline_keyword_match,
    load_standardized_dataset,
    load_standardized_dataset_local,
    standardize,
    standardize_catalog,
    standardize_tables,
)

__all__ = [
    "baseline_embedding_match",
    "baseline_keyword_match",
    "embedding_method",
    "evaluate",
    "evaluate_dataset",
    "evaluate_spec",
    "evaluate_spec_dataset",
    "function_method",
    "keyword_method",
    "load_standardized_dataset",
    "load_standardized_dataset_local",
    "method_registry",
    "model_method",
    "run_evaluation",
    "run_evaluation_specs",
    "standardize",
    "standardize_catalog",
    "standardize_tables",
]
