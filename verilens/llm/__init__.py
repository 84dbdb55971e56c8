"""Training-data operators: one module each, their registered queries in ``queries``.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
