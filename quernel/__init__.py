"""Select-project-join-sum analytics on Spark, from a terse text query language."""

from quernel.engine import Engine

__all__ = ["Engine"]
