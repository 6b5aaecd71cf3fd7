"""Operators for preparing training data: scans, encoders, filters, near-duplicate search, packing, sharding."""
