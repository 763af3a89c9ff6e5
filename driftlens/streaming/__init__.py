"""Fitted detectors on unbounded inputs."""

from driftlens.streaming.scoring import score_stream
from driftlens.streaming.upsert import upsert_stream

__all__ = ["score_stream", "upsert_stream"]
