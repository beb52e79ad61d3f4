"""A PySpark-native engine for record flows."""

from rillspark.flow import Flow, Writer, extend, flow, fn, is_flow, is_pipeline
from rillspark.plans.pipeline import Pipeline, pipeline

__all__ = ["Flow", "Pipeline", "Writer", "extend", "flow", "fn", "is_flow", "is_pipeline", "pipeline"]
