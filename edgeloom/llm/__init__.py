"""Training-data operators: ten DataFrame -> DataFrame building blocks.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` holds the thin ``opN_<name>``
queries that bind them to the driver's tables.
"""
