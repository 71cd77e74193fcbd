"""Operators for preparing training data from text, each by one named method."""
