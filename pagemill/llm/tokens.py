"""Token ids by the ``tokenizers`` library, with each distinct piece of text encoded once per worker.

Byte-pair models merge inside one pre-token only, so the ids of a text are the ids of its pre-tokens in order. Texts whose
characters all lie in ``SIMPLE`` (ASCII and the Latin-1 letters) are cut into pre-tokens here, where the split rule of the
tokenizer reads the same in Python and in the library; a piece is then looked up, or given to the tokenizer's own model. Other
texts go to the library in segments cut where a space separates ASCII letters, which is a pre-token border in any text.

The strings of special tokens are ordinary text, so that no document can write a control token into the token files: the library's
``encode_special_tokens``, as the notes beside the public vocabulary files set it. With ``special_text=False`` they are the special
tokens, as the library has it if nothing is set; a text that holds one then goes to the library whole.

Defined cases: null and empty texts have no ids; a very long text is cut into segments, and its ids are held at four bytes each.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import public_tokenizers
from tokenizers import Tokenizer

WORD_MODEL = "word_bpe_49k.json"
BYTE_MODEL = "byte_bpe_50k.json"
END_ID = 1

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OUTSIDE = re.compile(rf"[^\x20-\x7e\n\t\r{_LETTERS}]")
# The split patterns stored in the two tokenizer files, over the simple characters.
_SPLIT = {
    BYTE_MODEL: re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"),
    WORD_MODEL: re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+"),
}
_CUT = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z])")
_SEGMENT = 1 << 15
#: Pieces longer than this are encoded and not kept; when a cache has this many pieces it is emptied.
_KEPT_CHARS, _KEPT_PIECES = 40, 600_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level models: itself where printable, else the next free code from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(piece) <= _KEPT_CHARS:
            if len(self) >= _KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_open: dict[tuple[str, bool], Callable[[str | None], bytes]] = {}


def encoder(name: str, special_text: bool = True) -> Callable[[str | None], bytes]:
    """A function from a whole text (null: empty) to its ids as little-endian unsigned 32-bit integers, no special tokens added.

    ``name``: a file of ``public_tokenizers``, or the path of any ``tokenizers`` file. One per worker process.
    """
    if (name, special_text) not in _open:
        _open[name, special_text] = _encoder(name, special_text)
    return _open[name, special_text]


def _encoder(name: str, special_text: bool) -> Callable[[str | None], bytes]:
    tok = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
    tok.encode_special_tokens = special_text
    split, pieces = _SPLIT.get(name), _Pieces(tok.model)
    marks = [] if special_text else [re.escape(t.content) for t in tok.get_added_tokens_decoder().values()]
    special = re.compile("|".join(marks), re.I) if marks else None

    def by_library(text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + _SEGMENT)
            end = cut.start() if cut else len(text)
            out.append(array("I", tok.encode(text[at:end], add_special_tokens=False).ids).tobytes())
            at = end
        return b"".join(out)

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if special and special.search(text):
            return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()
        if split is None or _OUTSIDE.search(text):
            return by_library(text)
        if name == WORD_MODEL:
            text = text.lower()
        return b"".join(map(pieces.__getitem__, split.findall(text)))

    return encode
