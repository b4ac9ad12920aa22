"""cellgrid: N-dimensional array analytics as Spark DataFrames.

An array is a relation from integer index columns (``i0 ... ik``) to a value column, or a packed
``ARRAY`` column beside its row keys.  Dimensions an operator does not name are grouping keys.
"""

__version__ = "0.1.0"
