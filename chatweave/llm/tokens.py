"""Token ids of whole texts by a public byte-level BPE vocabulary.

``Encoder`` gives the ids of ``tokenizers`` for ``<name>.json``. Speed comes
from two exact shortcuts: the same vocabulary as ranks (``<name>.tiktoken``)
is merged by tiktoken, and chunks are cached. A text is cut before single
spaces; the vocabulary's pattern never joins what such a cut parts, unless the
space ends a longer run of white space (then the text is encoded whole).
A text that holds a special token's string goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

NAME = "byte_bpe_50k"
CACHE = 300_000  #: chunks kept per worker (about 150 MB)
_RUN = re.compile(r"\s (?!\S)")


class Encoder:
    def __init__(self, name: str = NAME):
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public.path(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merges = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        outer = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = np.array(outer.merges.encode_ordinary(chunk), dtype=outer.dtype).tobytes()
                if len(self) < CACHE and len(chunk) < 64:
                    self[chunk] = ids
                return ids

        self.chunks = Chunks()

    def ids(self, text: str | None) -> bytes:
        """The ids, each as ``dtype`` (little-endian)."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if _RUN.search(text):
            return np.array(self.merges.encode_ordinary(text), dtype=self.dtype).tobytes()
        first, *rest = text.split(" ")
        get = self.chunks.__getitem__
        return (get(first) if first else b"") + b"".join(map(get, [" " + x for x in rest]))

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // self.dtype.itemsize


@lru_cache(maxsize=4)
def encoder(name: str = NAME) -> Encoder:
    """One encoder per worker process."""
    return Encoder(name)
