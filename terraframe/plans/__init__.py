"""Every registered query of the library, by module."""

from terraframe.plans import aggregates, correction, neighbourhood, projection, rasters, sampling, storage  # noqa: F401
from terraframe.plans.registry import ORACLE, QUERIES  # noqa: F401
