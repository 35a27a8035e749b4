"""Sizes in tokens of a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
import os

#: Byte-level BPE ranks; never copied into the repository.
TOKENIZER = os.environ.get("LOOMSPAN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def make_counter(path: str = TOKENIZER):
    """A function of one text giving its number of tokens; special-token strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("loomspan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))
