"""shopgauge: retail store-performance analytics on Spark DataFrames."""

from .config import Params

__all__ = ["Params"]
