"""A Spark-first analytics engine for implicit-feedback recommendation."""

from . import blas  # noqa: F401
