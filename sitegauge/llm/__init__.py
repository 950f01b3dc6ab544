"""Operators for preparing text training data on Spark.

Nothing else in the package imports this one. Executors must be able to import it
(ship the package with ``--py-files`` or put it on their ``PYTHONPATH``).
"""
