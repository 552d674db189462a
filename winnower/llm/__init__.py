"""Training-data operators: filters, pseudonyms, deduplication, mixing, archives, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
