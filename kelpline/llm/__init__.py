"""Training-data operators: near-duplicate joins, packing, decontamination, scoring and coding.

Nothing outside this subpackage imports it; its queries are listed in ``registry``.
"""
