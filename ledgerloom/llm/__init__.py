"""Operators for training-data pipelines; nothing outside this folder imports it.

Each module holds one operator with its own general interface; ``registry``
maps the thin ``opN_<name>`` queries and their SQL to them.
"""
