"""Operators of a training-data pipeline over document tables.

One module per operator; ``queries`` registers the thin ``opN_<name>``
queries.  Nothing outside this folder imports it.
"""
