"""Training-data operators: filtering, deduplication, decontamination, media, archives, tokens.

Nothing else in the library imports this subpackage.
"""
