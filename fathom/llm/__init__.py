"""Training-data operators: filtering, deduplication, tokenisation and archives.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
