"""Operators for preparing training corpora: counting, cleaning, deduplicating, mixing and packing documents."""
