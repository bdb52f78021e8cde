"""Operators over DataFrames of pixels, samples and bytes: predictors, aggregates, lookups and byte codecs."""
