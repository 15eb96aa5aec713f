"""Operators: perturbation, tokens, fuzzy prior, posterior, study and report."""
