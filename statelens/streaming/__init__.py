"""Structured Streaming: histograms that follow a stream of activations, and a sink into the store."""

from .histogram import follow, stream_histogram, stream_metrics, to_store

__all__ = ["follow", "stream_histogram", "stream_metrics", "to_store"]
