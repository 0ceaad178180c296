"""The operators run on the driver's synthetic tables, with their SQL oracles."""

from . import q_columns, q_reports, q_scoring, q_tables, q_texts  # noqa: F401
from .registry import QUERIES, oracle_texts  # noqa: F401
