"""Operators for large training-data corpora, as Spark jobs.

One module per operator; ``queries`` registers them.  Nothing else in the
library imports this subpackage.
"""
