"""Every registered query of the core, with its SQL twin where one exists."""

from . import byte_queries, codec_queries, latency_queries, lookup_queries, scalar_queries, sequence_queries, signal_queries, source_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
