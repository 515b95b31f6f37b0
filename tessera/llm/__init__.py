"""Operators for building training data: extraction, mixing, sharding, counting, filtering, deduplication.

Columns that operators add begin with an underscore.  An input column of the same name is replaced
by the operator's own; all other input columns pass through, whatever they are called.
"""
