"""Operators for preparing training corpora: filtering, de-duplication, mixing, sharding and packing."""
