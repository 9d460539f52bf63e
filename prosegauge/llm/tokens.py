"""Token ids of public byte-level BPE vocabularies."""

from __future__ import annotations

import json
from functools import cache

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Encodes with the vocabulary of one ``tokenizers`` file.

    The ids are those of ``tokenizers`` with add_special_tokens=False, by which a
    special string that a text holds is its special id. The same vocabulary is handed to ``tiktoken``,
    which merges by the same ranks several times faster; a text that it can't
    take (its regular expression has a limit on backtracking) goes to
    ``tokenizers`` itself. A test holds the two against each other.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        # Fixed by the format: bytes that print stand for themselves, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    @property
    def reference(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        try:
            return np.asarray(self._fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the extension's panics don't derive from Exception
            return np.asarray(self.reference.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def encoder(path: str) -> ByteBpe:
    """One encoder for each worker process and file."""
    return ByteBpe(path)
