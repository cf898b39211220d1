"""Operators for preparing training corpora, one module each; see the README's list."""
