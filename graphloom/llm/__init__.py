"""Operators for training-data pipelines over a `documents(doc_id, text, ...)` table.

Nothing else in the library imports this subpackage.
"""
