"""Training-data operators over whole corpora of documents and vectors.

Nothing outside this subpackage imports it.
"""
