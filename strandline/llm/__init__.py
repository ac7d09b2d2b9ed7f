"""Training-data operators: each is a module with a general DataFrame interface.

Nothing else in the library imports it; ``corpus_pipeline.py`` counts as a part of it.
"""
