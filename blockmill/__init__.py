"""Spark-native extraction, chunking and text-processing operators.

Every operator is a DataFrame -> DataFrame function. See README.md.
"""

__version__ = "0.1.0"
