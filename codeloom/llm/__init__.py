"""Training-data operators: ten large-corpus operations on ``documents`` and ``embeddings``.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
