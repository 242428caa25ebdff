"""Token ids of whole texts through the tokenizers library, a word at a time.

Byte-pair encoders never merge across the pieces of their pre-tokenizer, so a text
is cut where such a piece surely ends and each unit's ids are looked up in a
bounded table that the library fills. Added tokens, such as ``<|endoftext|>``, are cut out
first, as the library does. ``tests/llm/test_packing.py`` holds the result against encoding texts in one go.

* ``word``: the normaliser and the splitting pattern treat white space only as a
  separator, so units are the words.
* ``byte``: a single space belongs to the word that follows it, and a single line
  feed between two words is a piece of its own; other white space stays inside a
  longer unit.
"""

from __future__ import annotations

import re
from array import array

#: Units that a worker remembers, by kind of encoder, and the longest of them in characters.
REMEMBERED, LONGEST = {"byte": 600_000, "word": 250_000}, 48
#: Places where a unit leaves a mark when it is met first (a power of two; units that share one are remembered too early, no more).
MET = 1 << 22

_CONTROL = re.compile("[\x1c-\x1f]")
# White space other than blank and line feed.
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = re.compile(r"(?<=\S) (?=\S)")


#: Letters and then marks, of which every pre-tokenizer here makes two pieces.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_names() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_NAMES = _byte_names()


def _odd(text: str) -> bool:
    """Whether there is white space that is no single blank or line feed between words."""
    return text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER.search(text) is not None


class _Units(dict):
    """Ids of units as they are asked for. Plain words go straight to the model, all others through the whole tokenizer."""

    def __init__(self, tokenizer, room: int, prefix: str = "", lower: bool = False):
        self.tokenizer, self.room, self.prefix, self.lower = tokenizer, room, prefix, lower
        self.model, self.marks = tokenizer.model, {}
        self.met = bytearray(MET)

    def piece(self, text: str, prefix: str = "") -> bytes:
        named = text if text.isascii() else "".join(map(_NAMES.__getitem__, text.encode()))
        return array("I", [t.id for t in self.model.tokenize(_NAMES[32] + named if prefix else named)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        m = _PLAIN.fullmatch(unit)
        if not m:
            ids = self.whole(self.prefix + unit)
        else:
            word, marks = m.groups()
            if marks:
                ids = self[word]
                if marks not in self.marks and len(self.marks) < self.room:
                    self.marks[marks] = self.piece(marks)
                ids += self.marks.get(marks) or self.piece(marks)
            else:
                ids = self.piece(word.lower() if self.lower else word, self.prefix)
        if len(self) < self.room and len(unit) <= LONGEST:
            at = hash(unit) & (len(self.met) - 1)
            if self.met[at]:  # at the second meeting: most units of a corpus are met but once
                self[unit] = ids
            self.met[at] = 1
        return ids


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit bytes; no special tokens are put around a text, those written in it count."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self.vocab_size = t.get_vocab_size(with_added_tokens=True)
        kind = type(t.pre_tokenizer).__name__
        self.part = {"ByteLevel": self._byte, "Sequence": self._word}.get(kind)
        if self.part is None:
            raise ValueError(f"no way to cut texts for the pre-tokenizer {kind}")
        added = t.get_added_tokens_decoder()
        if any(x.normalized or x.single_word or x.lstrip or x.rstrip for x in added.values()):
            raise ValueError("added tokens that depend on what is around them cannot be cut out")
        self.added = {x.content: array("I", [k]).tobytes() for k, x in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        room = REMEMBERED["word" if kind == "Sequence" else "byte"]
        self.first = _Units(t, room, lower=kind == "Sequence")
        self.spaced = _Units(t, room, " ")

    def encode(self, text: str) -> bytes:
        if not any(x in text for x in self.added):
            return self.part(text)
        return b"".join(self.added[x] if k % 2 else self.part(x) for k, x in enumerate(self.cut.split(text)))

    def _word(self, text: str) -> bytes:
        if _CONTROL.search(text):  # white space to Python alone
            return self.first.whole(text)
        return b"".join(map(self.first.__getitem__, text.split()))

    def _byte(self, text: str) -> bytes:
        if not text:
            return b""
        out, first, spaced = [], self.first.__getitem__, self.spaced.__getitem__
        if _odd(text):
            head, *rest = _SPACE.split(text)
            return first(head) + b"".join(map(spaced, rest))
        feed = b""
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out += (feed, first(head), *map(spaced, rest))
            feed = first("\n")
        return b"".join(out)


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, with its table, for each worker process."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
