"""textaudit: DataFrame operators for auditing gendered language in text collections.

Every public operator takes and returns Spark DataFrames keyed by document, so the
same job runs on a laptop sample or on a cluster.
"""

__version__ = "0.1.0"
