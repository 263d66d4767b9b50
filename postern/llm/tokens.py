"""Byte-level BPE ids of a public vocabulary."""

from __future__ import annotations

import json

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's file: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Ids:
    """Ids of whole texts, those that the JSON file at ``path`` gives without added special tokens.

    The file's added tokens (``<|endoftext|>``) have their own id where a text holds their string; with ``plain`` they are
    ordinary text. Its vocabulary runs in the rank encoder, which gives the same ids several times faster.
    """

    def __init__(self, path: str | None = None, plain: bool = False):
        import public_tokenizers
        import tiktoken

        with open(path or default_path(), "rb") as file:
            read = json.load(file)
        added = {t["content"]: t["id"] for t in read["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): n for token, n in read["model"]["vocab"].items() if token not in added}
        self.encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.allowed = set() if plain else set(added)

    def _of(self, text: str) -> list[int]:
        return self.encoder.encode(text, allowed_special=self.allowed, disallowed_special=())

    def encode(self, text: bytes | None) -> np.ndarray:
        return np.array(self._of(text.decode()) if text else [], np.uint32)

    def count(self, text: str) -> int:
        return len(self._of(text))
