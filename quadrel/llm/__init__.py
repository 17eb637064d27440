"""Operators for training-data pipelines: dedup, token counts, decontamination, personal data, extraction, quality, mixing and secrets."""
