"""Operators of a training-data pipeline: text in, decisions, digests and tables out.

Nothing else in the library imports this subpackage.
"""
