"""Operators that prepare training corpora; nothing else in the package imports them."""
