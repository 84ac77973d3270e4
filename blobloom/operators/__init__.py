"""Transforms, models, entropy coding and codecs over blob DataFrames."""
