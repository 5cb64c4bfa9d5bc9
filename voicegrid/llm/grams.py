"""Hashed character trigrams of texts, as bytes of UTF-8."""

from __future__ import annotations

import numpy as np


def trigram_buckets(text: bytes, bits: int) -> np.ndarray:
    """Bucket of every run of three bytes, A-Z lower-cased; a space is put before and after the text."""
    b = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)
