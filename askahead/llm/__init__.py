"""Operators on text corpora for training data: deduplication, decontamination, tokens, packing, quality, archives, secrets.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it.
"""
