"""Span-bearing parsers of bulletin texts: plain functions of strings, without Spark.

Each gives rows (dicts) whose start and end are code point offsets into the text it was given.
"""
