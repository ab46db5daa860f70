"""Operators for preparing training data, one module each.

Nothing else in the library imports this subpackage. ``registry`` lists the
queries and their SQL for the driver contract.
"""
