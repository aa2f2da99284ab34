"""Training-data operators: tokenising, filtering, de-duplication, mixing, sharding, fingerprints.

Nothing else in the library imports this subpackage.  ``registry`` holds its
queries and SQL twins; ``corpus_pipeline.py`` at the repository top chains five
of the operators.
"""
