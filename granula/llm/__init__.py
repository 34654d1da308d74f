"""Operators for large-scale training-data preparation on Spark.

Nothing else in the library imports this subpackage; its queries are listed in
:mod:`granula.llm.queries`.
"""
