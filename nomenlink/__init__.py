"""Nomenlink: company-name resolution and data quality as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver unless a function says so in its name or docstring.
"""

__version__ = "0.1.0"
