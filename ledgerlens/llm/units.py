"""Texts cut into pre-tokens: stretches that no token of the two kinds of public vocabulary crosses.

``space + text`` is cut before every space or line feed that follows a character that is no white space.  A
byte-level vocabulary splits there before its merges; a piece model merges over such a place only if one
of its pieces holds it, which :class:`Pieces` looks up when it loads a model.  Tokens of a text are then the
tokens of its pre-tokens one after the other, exactly.

A pre-token is a space and a word in most cases; that space is left out of its name.  So a name that begins with a
character other than white space stands for a space and the name, any other for itself.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable

MARK = "▁"
_ADJACENT = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def units(text: str) -> list[str]:
    """Names of the pre-tokens of a text that isn't empty, in order."""
    if text[0].isspace() or text[-1].isspace() or _ADJACENT.search(text):
        return [u[1:] if u[0] == " " and len(u) > 1 and not u[1].isspace() else u for u in _CUT.split(" " + text)]
    return text.replace("\n", " \n").split(" ")


def whole(text: str) -> list[str]:
    """The whole text as one pre-token."""
    return [" " + text if text[0].isspace() else text]


def spelled(name: str) -> str:
    """The characters that a name stands for."""
    return name if name[0].isspace() else " " + name


class Pieces:
    """A piece model: tokens and token bytes of pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.processor.get_piece_size()
        self.space = self.processor.piece_to_id(MARK)
        probe = " ﬁ①  Ａ \n x "
        plain = self.processor.normalize(probe) == (" " + probe).replace(" ", MARK)
        spans = (self.processor.id_to_piece(i).replace(MARK, " ") for i in range(self.size))
        #: Whether cuts are safe: no changes of the text before the merges, and no piece across a cut.
        self.divisible = plain and not any(re.search(r"\S[ \n]| \n", s) for s in spans)

    def units(self, text: str) -> list[str]:
        return units(text) if self.divisible else whole(text)

    def encode(self, name: str) -> list[int]:
        if not name[0].isspace():
            return self.processor.encode(name)
        if name == " ":
            return [self.space]
        # The model puts a space before each text; before a line feed it is a token of its own.
        return self.processor.encode(name[1:]) if name[0] == " " else self.processor.encode(name)[1:]

    def token_bytes(self) -> list[bytes]:
        """Bytes of every token: the mark is a space, byte pieces are their byte."""
        out = []
        for i in range(self.size):
            piece = self.processor.id_to_piece(i)
            out.append(bytes([int(piece[1:-1], 16)]) if self.processor.is_byte(i) else piece.replace(MARK, " ").encode())
        return out


class ByteLevel:
    """A byte-level vocabulary: tokens and token bytes of pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()

    def encode(self, names: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([spelled(n) for n in names], add_special_tokens=False)]

    def encode_text(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def token_bytes(self) -> list[bytes]:
        """Bytes of every token: printable bytes stand for themselves, the others for characters from 256 on."""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in printable}
        letters |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
        out = [b""] * self.size
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return out


def per_worker(name: str, build: Callable):
    """An object that a Python worker builds once and keeps over its tasks."""
    home = sys.modules.setdefault("_ledgerlens_worker", types.ModuleType("_ledgerlens_worker"))
    if not hasattr(home, name):
        setattr(home, name, build())
    return getattr(home, name)
