"""sparkprep: data profiling, quality checks and fit/transform preparation
operators expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
