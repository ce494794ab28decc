"""Session-efficiency analytics on Spark: transcripts in, spans, labels, waste patterns, cost and trends out."""

__version__ = "0.1.0"
