"""Token ids of a public byte-level BPE vocabulary, with a cache of space-separated units.

The ids equal those of the `tokenizers` library on the JSON file (add_special_tokens=False); tests hold them against
it. A text is cut before each space that doesn't stand within a longer run of white space: the pre-tokenizer always
cuts there, so each unit (with its leading space) can be encoded on its own, and repeated units cost one lookup.
Texts with other runs or with a special token's string go to `tokenizers` as a whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Units a worker's cache holds at most, and their longest length; others are encoded each time.
CACHE_UNITS = 400_000
CACHE_CHARS = 48
ID = np.dtype("<u4")

_AWKWARD = re.compile(r"\s (?:\s|\Z)")
_encoders: dict[str, Encoder] = {}


class _Units(dict):
    """Unit -> its ids as bytes; encodes what is missing."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self._encode, self._prefix = encode, prefix

    def __missing__(self, unit: str) -> bytes:
        ids = np.asarray(self._encode(self._prefix + unit), dtype=ID).tobytes()
        if len(unit) <= CACHE_CHARS and len(self) < CACHE_UNITS:
            self[unit] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        encode = self._ranked(path) or self._encode_whole
        self._first, self._rest = _Units(encode, ""), _Units(encode, " ")

    def _encode_whole(self, text: str) -> list[int]:
        return self._whole.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranked(path: str):
        """A faster encoder of the same vocabulary, if its rank file lies beside the JSON file."""
        import base64
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if not (path.endswith(".json") and os.path.exists(ranks)):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for a null text."""
        if not text:
            return b""
        if _AWKWARD.search(text) or any(s in text for s in self._special):
            return np.asarray(self._encode_whole(text), dtype=ID).tobytes()
        units = text.split(" ")
        first = self._first[units[0]] if units[0] else b""
        return first + b"".join(map(self._rest.__getitem__, units[1:]))


def encoder(path: str) -> Encoder:
    """This worker process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
