"""haloflux: exchange-flow analysis of gridded ocean output on Spark."""

from .schema import BinSpec, ControlVolume, SLevels
from .session import configure, local_session

__all__ = ["BinSpec", "ControlVolume", "SLevels", "configure", "local_session"]
