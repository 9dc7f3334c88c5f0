"""Vecloom: identity analytics over labelled embedding vectors, written as DataFrame-to-DataFrame operators."""
