"""Report and serving queries. Each takes a :class:`Tables` and returns a DataFrame."""

from .tables import Tables  # noqa: F401
