"""Operators for preparing training data, their queries and their SQL.

Nothing else in the library imports this subpackage; the driver contract adds
its queries only when it is present.
"""
