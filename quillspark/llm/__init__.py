"""Training-data operators: search, token counts, filters, classifiers, sharding, packing, near-dedup and mixing.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded hook in ``__spark_entry__.py``) imports it.
"""
