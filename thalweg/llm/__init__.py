"""Training-data operators: scoring, deduplication, search, scans, decontamination, packing, archives.

Nothing else in the library imports this subpackage; deleting it (with
``corpus_pipeline.py`` and ``tests/llm``) leaves the network engine whole.
"""
