"""Every query of the library on the provided tables."""

from . import channels, companions, design, exactly, joining, plugged, ranking, reports, runs, shares, simulating, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
