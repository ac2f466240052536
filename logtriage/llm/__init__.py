"""Operators of a training-data pipeline: licences, chat text, near duplicates, packing and more.

Nothing outside this package imports it; it may import the general helpers of the library.
"""
