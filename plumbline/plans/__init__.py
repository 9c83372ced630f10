"""Compositions of operators, profiles and the model boundary."""
