"""Tables and the state store."""

from .store import HistogramStore, StateStore
from .tables import table

__all__ = ["HistogramStore", "StateStore", "table"]
