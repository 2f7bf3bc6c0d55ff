"""Training-data operators: similarity joins, extraction, classifiers, tokenizers, packing.

Nothing else in the package imports this subpackage.
"""
