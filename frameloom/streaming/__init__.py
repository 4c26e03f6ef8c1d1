"""Streaming twins of the stateful operators, and idempotent sinks."""

from .events import event_filter_stream, tumbling_counts, write_idempotent

__all__ = ["event_filter_stream", "tumbling_counts", "write_idempotent"]
