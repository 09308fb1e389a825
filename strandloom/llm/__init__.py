"""Training-data operators: filters, deduplication, mixing, packing, sharding and token counts.

Nothing outside this folder imports it; each module holds one operator with a general interface.
"""
