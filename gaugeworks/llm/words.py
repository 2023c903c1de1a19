"""Tokenizers of vocabulary files, and where a long text may be cut for them.

Between two characters that are no white space, a single blank begins a new
piece for byte-level pre-tokenizers (a blank goes with what follows it) as for
vocabularies whose pieces hold a blank at their beginning only. A text cut there
has the tokens of its parts, so no more than a part is tokenized in one step.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np

#: White space here is all that any of the tokenizers may take for it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a text that are tokenized in one step, if it can be cut.
BLOCK = 1 << 20


def blocks(text: str) -> Iterator[str]:
    """The parts of a text, without the blanks between them."""
    at = 0
    while len(text) - at > 2 * BLOCK and (cut := _CUT.search(text, at + BLOCK)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _byte_of() -> dict[str, int]:
    """The byte that a character stands for in byte-level vocabularies: itself
    if it is printable Latin-1, else the others in order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary, as a file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        byte, special = _byte_of(), {t["content"]: t["id"] for t in held["added_tokens"]}
        self.path, self.special = path, special
        vocab = {bytes(byte[c] for c in token): n for token, n in held["model"]["vocab"].items() if token not in special}
        # merges of such a file come in the order of the ids that they make
        self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
        self.bytes = [b""] * (max(*vocab.values(), *special.values(), 0) + 1)
        for token, n in vocab.items():
            self.bytes[n] = token
        self.lens = np.array([len(t) for t in self.bytes], np.int64)

    @cached_property
    def _slow(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> list[int]:
        """Ids of a text in which the names of special tokens are plain text."""
        return self.fast.encode_ordinary(text)

    def encode_with_specials(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self._slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """A sentencepiece vocabulary whose pieces hold blanks only at their begin."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        raw = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := raw.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
        self.lens = np.array([len(t) for t in self.bytes], np.int64)
        #: Whether texts may be cut; a piece with a blank inside would span a cut.
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def byte_level(path: str, pattern: str) -> ByteLevel:
    """One per worker process; the file is read where the work is done."""
    return ByteLevel(path, pattern)


@lru_cache(maxsize=4)
def piece_level(path: str) -> Pieces:
    return Pieces(path)


def default_byte_level() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.PATTERN


def default_pieces() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")
