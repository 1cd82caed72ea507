"""Training-data operators: deduplication, scoring, rules, tokens, packing.

Nothing else in the package imports this subpackage.
"""
