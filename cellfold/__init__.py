"""cellfold: n-dimensional arrays, long series and object catalogs as Spark jobs."""

from cellfold.model import ArgumentError, Cells

__all__ = ["ArgumentError", "Cells"]
