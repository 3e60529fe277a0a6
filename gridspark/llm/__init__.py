"""Operators of a training-data pipeline: language, copies, mixing, tokens, licences, pages, vectors, scoring."""
