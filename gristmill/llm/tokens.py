"""Token ids of whole texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import os
from functools import cached_property

import numpy as np


class Tokens:
    """``tokenizer``: path of a tokenizers JSON file. If a rank file of the same vocabulary stands beside it (same
    name, .tiktoken), texts are encoded by those ranks, which give the same ids several times faster; texts with the
    string of a special token always go to the tokenizer itself."""

    def __init__(self, tokenizer: str):
        self.path = tokenizer
        with open(tokenizer, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        ranks = os.path.splitext(tokenizer)[0] + ".tiktoken"
        self.fast = self._ranks(ranks) if os.path.exists(ranks) else None

    @staticmethod
    def _ranks(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        """Loaded only where it is needed, since each Python worker holds its own."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def ids(self, text: str | None) -> np.ndarray:
        """Equal to the tokenizer's own ids of the whole text, without special tokens added; null is empty."""
        return np.array(self.encode(text) if isinstance(text, str) and text else [], np.uint32)


def default_tokenizer() -> str:
    """The public byte-level vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
