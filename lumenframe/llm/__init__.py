"""Training-data operators: archives, secrets, dedup, toxicity, search, PII, chat, mixing, decontamination.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
