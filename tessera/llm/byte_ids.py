"""Ids of the byte-level 50k vocabulary for whole texts."""

from __future__ import annotations

import base64
import json

import numpy as np

from .common import tokenizer_path


class ByteIds:
    """Little-endian unsigned 32-bit ids as the tokenizers library gives them for this vocabulary, the strings of special tokens included.

    The merges run on the same vocabulary in rank form, which is several times faster for whole texts.
    """

    def __init__(self, path: str | None = None) -> None:
        import tiktoken

        at = path or tokenizer_path("byte_bpe_50k.json")
        with open(at, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(at.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.lengths = np.zeros(max(*ranks.values(), *special.values()) + 1, np.int64)
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.lengths[i] = len(token)
        from public_tokenizers import PATTERN

        self.coder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a whole text."""
        return self.coder.encode_to_numpy(text.decode(), allowed_special="all").astype("<u4", copy=False)
