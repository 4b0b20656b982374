"""Queries over the sample tables, each with its SQL twin where one exists."""

# Importing enters the queries. The light ones come first: whoever runs them all in
# this order starts a session with small work, and streams on a session that is warm.
from . import retrieval, state, statistic, stored, difference, protect, continuous  # noqa: F401, I001
from .catalog import ENTRIES

__all__ = ["ENTRIES"]
