"""Training-data operators: token counts, joins, packing, dedup, classifiers, archives, media columns.

Nothing outside this subpackage imports it; ``wayfold.llm.registry`` lists its queries.
"""
