"""Token ids of whole texts, in tasks: the tokenizers library behind a memory of pieces."""

from __future__ import annotations

import os
import re
import string
from array import array
from functools import lru_cache
from unicodedata import is_normalized

#: Cuts before a space between two characters that are not white space. No pre-tokenizer of
#: the supported files joins across such a place.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: ASCII characters that are neither letters, digits nor white space.
_MARKS = string.punctuation


def _byte_characters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: printable Latin-1
    characters stand for themselves, the other bytes for code points from 256 on."""
    plain = {b for b in range(256) if 33 <= b < 127 or b > 160 and b != 173}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b if b in plain else 256 + rest.index(b)) for b in range(256)}


BYTE_CHARACTERS = _byte_characters()
_SPACE = BYTE_CHARACTERS[32]


def pieces(text: str) -> list[str]:
    """Parts that the tokenizer encodes independently of each other; joined, they are the text."""
    if "\x00" in text or " ".join(text.split()) != text.replace("\n", " "):
        return _CUT.split(text)
    return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")


class Encoder:
    """Encodes texts by ``tokenizers``; a piece of text that was met lately is not encoded again.

    ``lossy_space`` is for tokenizers that drop white space: pieces are then words. Pieces are
    remembered in two generations of at most ``most`` each; those still in use when the younger
    is full move on with it. A special token's string in a text is that token, as the library
    takes it; with ``plain`` it is ordinary text.
    """

    def __init__(self, path: str, lossy_space: bool, most: int = 500_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What the strings of special tokens begin with; a piece that holds it is left to the library.
        self.mark = os.path.commonprefix(special)
        if special and not self.mark:
            raise ValueError("special tokens have to begin alike")
        self.cut = (lambda text: text.replace("\n", " ").split(" ")) if lossy_space else pieces
        self.model = self.tokenizer.model
        self.lower = lossy_space
        self.most = most
        self.forget()

    def forget(self) -> None:
        """Give the memory of pieces back."""
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _word(self, piece: str) -> bytes | None:
        """Ids of a piece that is one run of letters, after a space or not: one pre-token, which
        goes straight to the library's model. None for any other piece."""
        spaced = piece[0] == " "
        letters = piece[1:] if spaced else piece
        if not letters.isalpha():
            return None
        if letters.isascii() and not (spaced and self.lower):
            # ASCII letters stand for themselves; only a space before them is written otherwise.
            plain = letters.lower() if self.lower else _SPACE + letters if spaced else letters
            return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        if self.lower:
            # In this range the normalizer changes nothing but the case of composed letters.
            if piece[0] == " " or max(piece) > "\u024f" or not is_normalized("NFC", piece):
                return None
            piece = piece.lower()
            if not piece.isalpha():  # a capital whose small form has a mark of its own
                return None
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARACTERS))]).tobytes()

    def _learn(self, words: set[str]) -> None:
        """See to it that the younger generation has ``words``."""
        wanted = words.difference(self.young)
        if len(self.young) + 2 * len(wanted) > self.most:
            self.old, self.young, wanted = self.young, {"": b""}, words - {""}
        young, old, new, ends, mark, word = self.young, self.old, [], [], self.mark, self._word
        for p in wanted:
            if (ids := old.get(p)) is not None:
                young[p] = ids
            elif mark and mark in p:
                new.append(p)
            elif (tail := len(p) - len(p.rstrip(_MARKS))) and p[:-tail][-1:].lower().isalpha():
                # A letter and the marks after it never share a pre-token, so both are encoded apart,
                # but for a capital whose small form ends with a mark of its own.
                parts = p[:-tail], p[-tail:]
                ends.append((p, *parts))
                for x in parts:
                    if x not in young:
                        if (ids := old.get(x)) is not None:
                            young[x] = ids
                        elif (ids := word(x)) is not None:
                            young[x] = ids
                        else:
                            young[x] = b""
                            new.append(x)
            elif (ids := word(p)) is not None:
                young[p] = ids
            else:
                new.append(p)
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                young[piece] = array("I", e.ids).tobytes()
        for p, stem, marks in ends:
            young[p] = young[stem] + young[marks]

    def of_pieces(self, some: list[str]) -> list[bytes]:
        """Ids of texts that are one piece each, so need no cut."""
        self._learn(set(some))
        return list(map(self.young.__getitem__, some))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.cut(x) for x in texts]
        self._learn(set().union(*parts))
        ids = self.young.__getitem__
        return [b"".join(map(ids, p)) for p in parts]


@lru_cache(maxsize=4)
def encoder(path: str, lossy_space: bool, plain: bool = False, most: int = 500_000) -> Encoder:
    """One encoder a Python worker; its cache lasts over tasks."""
    return Encoder(path, lossy_space, most, plain)
