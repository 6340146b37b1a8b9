"""Training-data operators: scans, classifiers, near-duplicate search and mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
