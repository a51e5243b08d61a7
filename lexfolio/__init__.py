"""lexfolio: document intelligence over Spark DataFrames.

Contracts, resumes and other prose become queryable facts: canonical text with
exact offsets, clause trees, obligations, rule findings with citations, profile
and requirement matches, and batch hybrid search.
"""

__version__ = "0.1.0"
