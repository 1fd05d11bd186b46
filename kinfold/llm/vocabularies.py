"""Where the files of public tokenizers are; operators take the path as a parameter."""

from __future__ import annotations


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
