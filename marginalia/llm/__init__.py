"""Training-data operators: deduplication, scoring, extraction, search and mixing.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
