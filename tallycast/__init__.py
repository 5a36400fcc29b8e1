"""tallycast - probabilistic analysis of multivariate count series on Spark DataFrames."""

__version__ = "0.1.0"
