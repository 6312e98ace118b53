"""Training-data operators.

Everything here is optional: no other part of the library imports this
subpackage, so it can be removed without touching the retrieval engine.
"""
