"""Operators for preparing training text; nothing outside this folder imports it.

Each module holds one operator over a table of documents; ``queries`` applies them to the test
tables. Columns are named by the caller and every other column of the input is ignored, so that
extra columns of any name do no harm.
"""
