"""Ids of texts by a byte-level BPE file.

The file is one of the tokenizers library's; its vocabulary and its pattern are applied by tiktoken's engine,
which merges the same bytes in the same order several times as fast. A test holds the ids against the library
itself on every given document.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: the pattern that the byte-level pre-tokenizer cuts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shown_bytes() -> dict[str, int]:
    """The character by which a byte-level vocabulary shows each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteEncoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        cut_by = given["pre_tokenizer"]
        if cut_by["type"] != "ByteLevel" or cut_by["add_prefix_space"] or not cut_by.get("use_regex", True) or given["normalizer"]:
            raise ValueError("not a plain byte-level vocabulary")
        shown, special = shown_bytes(), {t["content"]: t["id"] for t in given["added_tokens"]}
        ranks = {bytes(shown[c] for c in token): number for token, number in given["model"]["vocab"].items() if token not in special}
        self.special = set(special)
        self.engine = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        self.path = path

    def encode(self, text: str | None) -> np.ndarray:
        """The text's ids as unsigned 32-bit numbers; null is empty. The file's special tokens stand for themselves."""
        try:
            return self.engine.encode_to_numpy(text or "", allowed_special=self.special, disallowed_special=())
        except ValueError:  # its pattern engine gives up on very long runs of white space; the library doesn't
            from tokenizers import Tokenizer

            return np.array(Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
