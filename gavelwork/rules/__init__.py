"""Rules kept as data: thresholds, word lists, patterns, ranks.

Operators take these as arguments, so other domains can pass other rows.
"""
