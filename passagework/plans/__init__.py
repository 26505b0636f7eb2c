"""Scorers and searches that put operators together."""
