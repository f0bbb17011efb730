"""A governed analytics engine on Spark: plans, entities, policies, text and data movement."""

from .errors import EngineError

__all__ = ["EngineError"]
