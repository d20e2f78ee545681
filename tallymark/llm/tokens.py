"""Public byte-level vocabularies inside tasks; nothing is trained and no file is copied."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary with its one special token, as the tokenizers file of the same vocabulary has it."""
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens=SPECIAL)


@lru_cache(maxsize=1)
def pieces() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def default_path() -> str:
    return public_tokenizers.path(RANKS)
