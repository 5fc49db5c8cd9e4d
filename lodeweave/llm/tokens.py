"""Token ids by a public byte-level BPE vocabulary, for use inside tasks."""

from __future__ import annotations

import base64

import numpy as np

#: The places of the vocabulary's files, as parameters of every operator that takes tokens.
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
END_OF_DOCUMENT = 50256


class Encoder:
    """``encode(text)``: the ids of a text as little-endian unsigned 32-bit integers.

    The ids are those of ``tokenizers`` with ``add_special_tokens=False``: a text that spells out the
    vocabulary's special token is left to that library, as is one whose run of white space is too long for the
    other's pattern (a million or so); every other text goes through the same vocabulary's ranks.
    ``memo`` is without effect: looking pre-tokens up takes longer than merging them.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None, memo: int = 0):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={SPECIAL: END_OF_DOCUMENT})
        self.library = None

    def _by_library(self, text: str, ordinary: bool) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary)
        self.library.encode_special_tokens = ordinary
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return self._by_library(text, False) if text and SPECIAL in text else self.encode_ordinary(text)

    def encode_ordinary(self, text: str | None) -> bytes:
        """As ``encode``, but a special token that a text spells out is ordinary text, so that its id never occurs."""
        if not text:
            return b""
        try:
            return self.bpe.encode_to_numpy(text, disallowed_special=()).tobytes()
        except ValueError:
            return self._by_library(text, True)
