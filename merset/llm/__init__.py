"""Operators for preparing large text corpora, each a set of Spark jobs.

Nothing outside this folder imports it (``corpus_pipeline.py`` belongs to it).
"""
