"""Operators for preparing training text at scale: near-duplicate removal, language,
personal data, quality, contamination, fingerprints, tokens, model scores, token files
and list filters. Nothing else in the library imports this subpackage.
"""
