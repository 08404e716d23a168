"""Training-data operators: archives, tokenisation, deduplication, filtering, mixing, sharding.

Each module holds one operator with a general interface; ``queries.py`` derives the
contracted digest columns from them.  Nothing outside this subpackage imports it.
"""
