"""Training-data operators: search, classification, tokenisation, packing, deduplication and scans.

Nothing outside this folder imports it.
"""
