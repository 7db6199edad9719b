"""Lot-quality analytics on Spark DataFrames.

Sub-packages: ``sources`` (readers, writers, rule packs), ``functions`` (column helpers), ``operators``
(one DataFrame in, one DataFrame out), ``plans`` (composed jobs), ``streaming`` (Structured Streaming
forms) and ``catalog`` (runnable queries with their SQL twins).
"""
