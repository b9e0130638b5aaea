"""Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

The merges of such a file stand in the order of the ids they make, so the pieces and their ids are all that encoding
needs. ``tiktoken`` runs the same merges several times faster; both libraries cut texts by the same published pattern
(their ids agree on every code point, which the tests repeat on a sample). A file that does not have this form is handed to
the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

# The pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteBpe:
    """Encoder of one tokenizer file; ``token_bytes`` has the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = _byte_of_letter(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in self.special}
        self.size = max([*pieces.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * self.size
        for piece, i in pieces.items():
            self.token_bytes[i] = piece
        for piece, i in self.special.items():
            self.token_bytes[i] = piece.encode()
        before = spec.get("pre_tokenizer") or {}
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        as_ranks = (spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                    and not before.get("add_prefix_space") and made == sorted(made) and not model.get("ignore_merges"))
        if as_ranks:
            import tiktoken

            self._ranks = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=pieces,
                                            special_tokens=self.special)
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._ranks, self._library = None, Tokenizer.from_file(path)

    def encode(self, texts: list[str], special: bool) -> list[np.ndarray]:
        """Ids of every text. With ``special`` the strings of special tokens become their ids, else they are plain text."""
        if self._ranks is not None:
            allowed = set(self.special) if special else set()
            return [self._ranks.encode_to_numpy(t, allowed_special=allowed, disallowed_special=()) for t in texts]
        self._library.encode_special_tokens = not special
        return [np.array(e.ids, np.uint32) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """Kept by the worker process for all its tasks."""
    return ByteBpe(path)
