"""Analyses (s01-s38 over the loan table, g01-g15 over native tables) and their SQL oracles."""
