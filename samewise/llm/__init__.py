"""Training-data operators: decontamination, deduplication, filters, PII, tokens, models, media.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
