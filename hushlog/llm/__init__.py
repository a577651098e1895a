"""Operators that prepare training text: counts, cleaning, joins and output of token ids."""
