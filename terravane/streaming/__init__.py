"""Streaming forms of incremental operators.

The batch operators define the results; these wrappers run them over file streams. Windows over event time are an extension:
no operator of the inventory has them.
"""
