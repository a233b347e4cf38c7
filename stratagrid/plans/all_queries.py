"""Every query module, so that importing this one fills the registry."""

from . import criteria_queries, detail_queries, note_queries, report_queries  # noqa: F401
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
