"""Relational, panel, spatial and record-processing operators over DataFrames."""
