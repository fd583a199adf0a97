"""Operators for preparing training text: one module per operator, each with its own general interface.

The registered queries and their SQL are in ``registry``; the chained stages are in ``corpus_pipeline.py``
at the top of the repository.
"""
