"""meetspark: constraint validation, unification and generation over Spark DataFrames."""

__version__ = "0.1.0"
