"""Operators for preparing training text: scrubbing, scoring, mixing and output.

Nothing outside this folder imports it.
"""
