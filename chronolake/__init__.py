"""A time-series analytics engine on PySpark DataFrames."""

from .catalog import Database, Table
from .errors import EngineError
from .functions.keys import Key
from .operators.query import Query

__all__ = ["Database", "EngineError", "Key", "Query", "Table"]
