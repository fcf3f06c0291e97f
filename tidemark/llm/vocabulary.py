"""What a byte-level tokenizer file says about its tokens' bytes."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


def _byte_of_character() -> dict[str, int]:
    """Byte-level tokenizers print each byte as one character: visible ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    tokenizer: object
    token_bytes: list[bytes]
    #: Bytes of each id, all ids' bytes after one another, and where each begins.
    lengths: np.ndarray
    flat: np.ndarray
    begins: np.ndarray
    added: list[bytes]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        source = np.repeat(self.begins[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.flat[source].tobytes()


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The tokenizer of a .json file, one thread, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    byte, added = _byte_of_character(), tokenizer.get_added_tokens_decoder()
    words = tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(words.values()) + 1)
    for word, k in words.items():
        table[k] = added[k].content.encode() if k in added else bytes(byte[c] for c in word)
    lengths = np.array([len(x) for x in table], np.int64)
    return Vocabulary(tokenizer, table, lengths, np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, [t.content.encode() for t in added.values()])
