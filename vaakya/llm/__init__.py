"""Training-data operators: quality, tokens, language, packing, rules, PII, dedup, toxicity, LM scores, near-duplicate join.

Nothing else in the library imports this subpackage.
"""
