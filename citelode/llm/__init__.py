"""Training-data operators: cleaning, deduplication, tokenisation and packing.

Nothing outside this subpackage imports it. Each module holds one operator with
its own interface; ``queries`` derives the registered queries from them.
"""
