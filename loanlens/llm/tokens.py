"""Token ids of whole texts by a public tokenizer of the ``tokenizers`` library, with words remembered.

Both tokenizers used here split a text at white space before anything else, so a text's ids are those of its
chunks in order. Chunks repeat; the ids of each are kept, up to a bound.
"""

import re
from array import array
from functools import cache
from os.path import commonprefix

#: Chunks and words whose ids a task keeps; then it starts over.
KEPT_CHUNKS, KEPT_WORDS = 450_000, 250_000
#: Latin letters that stay as they are under NFC, and a tail of ASCII punctuation: two units for either tokenizer.
_SIMPLE = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-įĀ-į]+)([!-/:-@\[-`{-~]*)")
#: White space outside ASCII, on which the splits below would not agree with the tokenizer's.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CHUNKS = re.compile(r" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")


def _byte_letters() -> dict[int, str]:
    """The usual stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


class _Kept(dict):
    """Remembers what ``make`` returned, up to ``most`` keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers: those of the library's plain call.

    Strings of special tokens in a text are their tokens, as in that call; such texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: What all strings of special tokens begin with; "" (in every text) if they have nothing in common.
        self.mark = commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()] or ["\0"])
        self.model, self.lower = self.tokenizer.model, self.tokenizer.normalizer is not None
        self.letters = _byte_letters()
        self.words = _Kept(self._word, KEPT_WORDS)
        self.chunks, self.spaced = _Kept(self._chunk, KEPT_CHUNKS), _Kept(lambda c: self._chunk(" " + c), KEPT_CHUNKS)

    def _word(self, unit: str) -> bytes:
        mapped = unit.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.words[chunk.lower() if self.lower else chunk]
        m = _SIMPLE.fullmatch(chunk)
        if m is None:
            return self._whole(chunk)
        word = m[1] + m[2] if not self.lower else m[2].lower()
        return self.words[word] + (self.words[m[3]] if m[3] else b"")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.mark in text or _ODD_SPACE.search(text):
            return self._whole(text)
        chunk = self.chunks.__getitem__
        if self.lower:  # a normalising tokenizer drops white space
            return b"".join(map(chunk, text.split()))
        if any(x in text for x in ("  ", "\n ", " \n", "\n\n", "\t", "\r", "\x0b", "\x0c")):
            return b"".join(map(chunk, _CHUNKS.findall(text)))
        spaced, out = self.spaced.__getitem__, []
        for line in text.split("\n"):  # a single space belongs to the word after it, a line break to none
            first, *rest = line.split(" ")
            out += [self.chunks[first]] if first else []
            out += map(spaced, rest)
            out.append(self.chunks["\n"])
        return b"".join(out[:-1])


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
