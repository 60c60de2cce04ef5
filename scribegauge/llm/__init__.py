"""Training-data preparation operators (filters, deduplication, formatting, scoring).

Nothing else in the library imports this subpackage.  Operators live in one
module each; ``queries`` binds them to the driver's tables.
"""
