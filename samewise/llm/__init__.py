"""Operators of a training-data pipeline: sharding, language ID, mixing, decontamination, near-duplicates, archives, personal
data, quality rules, repeated passages and license scans."""
