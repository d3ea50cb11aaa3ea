"""Training-data operators: counting, scoring, filtering, mixing and encoding of document tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
