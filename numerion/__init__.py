"""Numerion: reading numerals out of images with Spark DataFrames.

Tabular stages (boxes, components, lines, votes, scores) are Catalyst
expressions; dense pixel stages are vectorised Arrow functions.
"""
