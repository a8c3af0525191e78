"""moldwatch: machine-telemetry analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers for telemetry, production logs, scored history, sinks
functions  column expressions (cleaning, ids, rounding, guards)
operators  joins, windows, aggregations, sampling, limits, alerts, forecasts
ml         Spark ML training / scoring / explanation
plans      compositions of operators (status check, control room, training set)
streaming  Structured Streaming live state and windows
"""
from moldwatch.session import get_session, checkpoint_dir, materialize  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "materialize"]
