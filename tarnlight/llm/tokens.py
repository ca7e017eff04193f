"""Token ids of whole texts, as numpy arrays.

The ids are those of a byte-level BPE file of the `tokenizers` library. Where a rank file of the same
vocabulary lies beside it, texts of characters below U+0250 take the faster library of that file; both
give the same ids there (tests/llm/test_tokens_and_packing.py compares them). A text with the literal form of a special
token, or with other characters, is encoded by `tokenizers`.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

EOS_ID = 1
_OTHER = re.compile("[^\u0000-ɏ]|<\\|endoftext\\|>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if ranks != path and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.fast is None or _OTHER.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        return self.fast.encode_to_numpy(text).astype(np.int32)

    @property
    def byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes of each id; the ids of a text are a partition of its bytes."""
        if not hasattr(self, "_lengths"):
            vocab = self.slow.get_vocab(with_added_tokens=True)
            out = np.zeros(max(vocab.values()) + 1, np.int64)
            special = {v.content for v in self.slow.get_added_tokens_decoder().values()}
            for token, i in vocab.items():  # one character stands for each byte in such vocabularies
                out[i] = len(token.encode()) if token in special else len(token)
            self._lengths = out
        return self._lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
