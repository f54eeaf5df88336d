"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

``QUERIES`` holds one query per operator over its whole table, ``ORACLES`` the SQL counterparts where SQL can say it.
"""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
