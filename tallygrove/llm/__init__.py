"""Training-data operators: mixing, near-duplicates, private data, secrets, languages, tokens and quality.

Nothing outside this subpackage imports it.
"""
