"""Operators of the model builder, each a plain function over DataFrames."""
