"""Training-data operators: scoring, deduplication, filtering, PII, packing, sharding.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
