"""Operators for preparing training data: media, fingerprints, quality, URLs, mixing, near and line dedup,
sharding, token counts and packing. Nothing else in the library imports this subpackage."""
