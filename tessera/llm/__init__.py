"""Operators for large training corpora: cleaning, de-duplication, formatting and tokenised output.

Nothing outside this subpackage imports it.
"""
