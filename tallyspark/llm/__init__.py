"""Operators for building language-model training data on Spark.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
``opN_<name>`` queries and ``__spark_entry__`` adds them when it can.
"""
