"""Collection catalog on Spark: normalize, build, search, rank and merge collection records."""

__version__ = "0.1.0"
