"""Document queries compiled to Spark DataFrames."""

from .client import Client, Collection, Cursor, Database
from .errors import EngineError

__all__ = ["Client", "Collection", "Cursor", "Database", "EngineError"]
