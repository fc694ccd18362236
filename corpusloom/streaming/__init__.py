"""Running the per-row operators over files as they arrive."""

from corpusloom.streaming.views import append_stream, read_stream

__all__ = ["append_stream", "read_stream"]
