"""Operators for training corpora: counting, cleaning, deduplicating, packing and storing texts and vectors."""
