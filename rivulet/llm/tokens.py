"""Token ids of the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import json
from pathlib import Path

END_OF_TEXT = "<|endoftext|>"


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The vocabulary in path (a .tiktoken file of ranks), with the added tokens of the .json file beside it, if there is one."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
    whole = Path(path).with_suffix(".json")
    added = {t["content"]: t["id"] for t in json.loads(whole.read_text("utf-8"))["added_tokens"]} if whole.exists() else {}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of byte_bpe_50k, the vocabulary of byte_bpe_50k.json written as ranks; the ids are the same."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
