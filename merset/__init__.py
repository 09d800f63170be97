"""Spark engine for well-separated k-mer selection over tables of text.

Subpackages: ``functions`` (column expressions), ``sources`` (universes and
tables), ``operators`` (joins, graph steps, greedy rounds) and ``plans``
(whole queries).
"""

__version__ = "0.1.0"
