"""Streaming counterparts of the binning operators."""
