"""Training-data operators: mixing, sharding, filtering, near-duplicate search, packing.

Nothing outside this subpackage imports it; see the README for the operators' contracts.
"""
