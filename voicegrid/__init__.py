"""Customer-feedback analytics as Spark jobs."""

from voicegrid.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
