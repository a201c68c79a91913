"""Training-data operators (quality, licences, media, packing, near-duplicates, ...).

Nothing else in the library imports this subpackage; ``quire.llm.registry`` maps
query names to functions and is imported only by the entry module.
"""
