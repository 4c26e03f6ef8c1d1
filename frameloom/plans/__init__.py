"""Pipelines as lists of operator specs, with rewrites before they are built."""

from .pipeline import Metric, Op, Pipeline, crop_push_down, multi_metric_region, validate

__all__ = ["Metric", "Op", "Pipeline", "crop_push_down", "multi_metric_region", "validate"]
