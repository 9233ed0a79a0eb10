"""Operators of a training-data pipeline: sharding, filters, near copies, packing, archives."""
