"""Operators of a training-data pipeline: tokens, near copies, quality, privacy, packing, chat.

Each module holds one operator with a general interface (any column names,
extra columns kept); ``queries`` derives the registered digest queries.
"""
