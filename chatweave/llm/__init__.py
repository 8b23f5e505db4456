"""Operators for preparing training data: one module per operator.

Nothing outside this folder imports it; ``queries.QUERIES`` and
``oracles.ORACLES`` are added to the registry by ``__spark_entry__`` only.
"""
