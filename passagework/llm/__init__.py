"""Training-data operators: licence scans, chat repair, source mixing, personal data,
toxicity, decontamination, language, near and exact duplicates, quality.

Nothing outside this subpackage imports it.
"""
