"""Whole jobs made of the operators; unlike operators they read and write."""
