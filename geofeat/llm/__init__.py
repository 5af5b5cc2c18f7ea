"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage: its queries and SQL live in
``queries.py`` here, and ``__spark_entry__.py`` adds them only when it is present.
"""
