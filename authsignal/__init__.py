"""Authentication-anomaly analytics over decoded control-plane packets, on Spark."""

from authsignal.config import DetectorConfig

__all__ = ["DetectorConfig"]
