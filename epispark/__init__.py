"""epispark: disease-surveillance indicators as lazy Spark DataFrames."""

from epispark.functions.filters import Filters
from epispark.spec import TB, AreaDim, CaseSpec, brazil

__all__ = ["TB", "AreaDim", "CaseSpec", "Filters", "brazil"]
