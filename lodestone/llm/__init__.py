"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general interface; ``queries`` wraps them as registered queries.
"""
