"""Tessella: a PySpark-native engine for relational, text, vector and graph data.

Sub-packages: ``sources`` (readers, writers), ``functions`` (column expressions),
``operators`` (DataFrame in, DataFrame out), ``plans`` (registered queries with
their SQL twins), ``streaming`` (Structured Streaming twins of batch operators).
"""
