"""Operators of a training-data pipeline. Nothing outside this subpackage and
``corpus_pipeline.py`` imports it."""
