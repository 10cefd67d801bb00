"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Executors import it too:
ship the repository with ``--py-files`` or on the executors' PYTHONPATH.
"""
