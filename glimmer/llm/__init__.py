"""Training-data operators: mixing, decontamination, deduplication, counting, packing, archiving, quality.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
