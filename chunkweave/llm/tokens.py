"""Token ids of whole texts by the public `word_bpe_49k.json` vocabulary, encoded word by word.

The vocabulary's own rules never look across white space: it is dropped, and no pattern spans it. So the
ids of a text are those of its words one after another, and a bounded per-process memo of words
replaces most of the work. Plain Latin words take the model's merge step directly; any other word
(other scripts, combining marks, special strings) goes through the full tokenizer.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

#: Words whose normal form is their lower case and whose letters and digits are known.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The vocabulary's split pattern, for plain words.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: str.split() also cuts at these four, which are no white space to the vocabulary.
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[ \t-\r]+")
#: Words in each of the memo's two generations.
MEMO = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class WordIds(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes. Two generations bound its size."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            ids = []
            for piece in PIECES.findall(word.lower()):
                if not piece.isascii():
                    piece = "".join([self.letters[b] for b in piece.encode()])
                ids += [t.id for t in self.merge(piece)]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        found = filter(None, BLANK.split(text)) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, found))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memo for each process and vocabulary."""
    return WordIds(path)
