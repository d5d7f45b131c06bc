"""evenhand: group-fairness audits of binary decisions as Spark DataFrame jobs."""

__version__ = "0.3.1"
