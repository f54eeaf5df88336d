"""Profiling, cleaning and feature engineering of large tables with PySpark."""

from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .plans import *  # noqa: F403
from .plans import __all__ as _plans
from .sources import *  # noqa: F403
from .sources import __all__ as _sources

__all__ = [*_operators, *_plans, *_sources]
