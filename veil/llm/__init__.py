"""Operators for large training corpora: sharding, tokenizing, deduplication, search and scoring.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; ``veil.llm.queries`` derives the digest columns that the registered queries return.
"""
