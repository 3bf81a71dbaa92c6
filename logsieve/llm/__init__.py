"""Operators for preparing training corpora: cleaning, de-duplication, scoring, mixing and token output."""
