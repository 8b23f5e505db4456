"""Token ids of whole texts by a public lower-casing word BPE vocabulary.

``Encoder.ids`` gives the ids that ``tokenizers`` gives for ``<name>.json``
without special tokens added. Texts made of ASCII and Latin letters are in
normal form as they are, so they are lower-cased and cut by the vocabulary's own
pattern, and each distinct piece is merged once per worker. In other texts,
chunks between single spaces are independent (no step of the vocabulary looks
across a space) and are cached by the same rule. A text that holds a special
token's string goes to ``tokenizers`` whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

NAME = "word_bpe_49k"
CACHE = 500_000  #: pieces kept per worker (about 100 MB)
LONGEST = 64  #: characters of a piece that is kept

#: Letters whose lower case and normal form need no context (no dotted capital I).
LOWER = "a-zß-öø-įı-ſ"
SIMPLE = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-įı-ſ]*\Z")
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LOWER}]+|[0-9]|[^\s{LOWER}0-9]+")


def byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level BPE: the
    byte's own if Latin-1 prints it, else the next one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class _Cache(dict):
    """ids of a piece, made by ``make`` when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(self) < CACHE and len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, name: str = NAME):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers as public
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public.path(f"{name}.json"))
        self.special = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.whole, letters, merges = whole, byte_letters(), whole.model

        def merged(piece: str) -> bytes:
            found = merges.tokenize(piece.encode("utf-8").decode("latin-1").translate(letters))
            return np.array([t.id for t in found], dtype=self.dtype).tobytes()

        def chunk(text: str) -> bytes:
            if SIMPLE.match(text):
                return b"".join(map(pieces.__getitem__, PIECE.findall(text.lower())))
            return self._plain(text)

        pieces, chunks = _Cache(merged), _Cache(chunk)
        self.piece_ids, self.chunk_ids = pieces.__getitem__, chunks.__getitem__

    def _plain(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The ids, each as ``dtype`` (little-endian)."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._plain(text)
        if SIMPLE.match(text):
            return b"".join(map(self.piece_ids, PIECE.findall(text.lower())))
        return b"".join(map(self.chunk_ids, text.split(" ")))


@lru_cache(maxsize=2)
def encoder(name: str = NAME) -> Encoder:
    """One encoder per worker process."""
    return Encoder(name)
