"""Operators for large text corpora: exact and near dedup, URL filters, packing, source mixing, substring
dedup, token files, secret scans, nearest neighbours and a quality classifier.

``queries`` holds the registered queries and their SQL. Nothing outside this folder imports it.
"""
