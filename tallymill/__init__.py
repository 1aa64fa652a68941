"""Spark jobs over large evaluation logs of language models.

Read result documents, extract answers, score them, roll scores up, compare
runs, sample responses and assemble labelled test tables -- on DataFrames.
"""
