"""Operators for training-data pipelines.

Nothing outside this folder imports it. Each module holds one operator with a general interface; ``queries`` registers one
query ``opN_<name>`` for each over the whole driver tables.
"""
