"""Where the public tokenizer files lie on this machine (never copied)."""

from __future__ import annotations


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
