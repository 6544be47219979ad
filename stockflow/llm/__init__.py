"""Operators of a large-scale training-data pipeline: deduplication, language
modelling, quality and URL filters, packing, archives, decontamination.

Nothing else in the library imports this package.
"""
