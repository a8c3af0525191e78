"""Readers and writers."""
from moldwatch.sources.tables import (  # noqa: F401
    read_table, telemetry_raw, production_log_raw, scored_raw, lineitem_events,
)
