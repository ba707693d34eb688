"""Encoders over public vocabulary files, whose paths are parameters. One per Python worker and file."""

from __future__ import annotations

import base64
import os

_encoders: dict[str, object] = {}
_tokenizers: dict[str, object] = {}


def tiktoken_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizers_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_at(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoder(path: str):
    """A tiktoken Encoding without special tokens."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_at(path), special_tokens={})
    return _encoders[path]


def tokenizer(path: str):
    """A tokenizers Tokenizer that takes strings of special tokens as ordinary text."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]
