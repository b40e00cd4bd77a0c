"""The public byte-level vocabulary inside tasks."""

from __future__ import annotations

import base64
import functools

import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k"
END_MARK, END_ID = "<|endoftext|>", 50256


@functools.cache
def ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


@functools.cache
def encoder(path: str | None = None) -> tiktoken.Encoding:
    """Gives the ids of the vocabulary's tokenizers file, its mark in a text being the special token."""
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={END_MARK: END_ID})


def encode(text: str) -> list[int]:
    return encoder().encode(text, allowed_special="all") if END_MARK in text else encoder().encode_ordinary(text)
