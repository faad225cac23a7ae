"""Token ids of whole texts, by the tokenizers library, remembered piece by piece."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import kept

#: Letters and numbers among the characters of common texts: ASCII, and U+00A1 to U+017F without U+0130 (whose
#: lower case is two characters). In these no normal form, and no version of Unicode, makes a difference.
L, N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
UNCOMMON = re.compile("[^\n\x20-\x7e\xa1-įı-ſ]")
#: The two vocabularies' pre-tokens over those characters; alternatives that can't begin alike may change places.
SPACE_LEADS = re.compile(rf" ?[{L}]+| ?[{N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{L}{N}]+|\s+(?!\S)|\s+")
SPACE_DROPS = re.compile(rf"[{L}]+|'(?:s|t|re|ve|m|ll|d)|[{N}]|[^\s{L}{N}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: its own if that is visible, else the next
    free one from U+0100."""
    table, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[b] = chr(b)
        else:
            table[b] = chr(free)
            free += 1
    return table


class Bounded(dict):
    """key -> what ``make`` gives for it, remembered for a bounded number of short keys: a young and an old half,
    and what is asked for again before its half goes is kept."""

    LIMIT, LONG = 300_000, 64

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: How the two known kinds of vocabulary are set up; a file that says anything else goes through the library alone.
SET_UP = {
    True: {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    },
    False: {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
}


class PieceEncoder:
    """Text -> ids as unsigned 16-bit numbers (both kinds of vocabulary have less than 2**16 ids).

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: the string of a special token in a
    text becomes its id, unless ``plain_specials`` makes it ordinary text. A text of common characters without such
    a string is cut at its spaces, each part into pre-tokens, and each pre-token is merged by the tokenizer's model;
    what a part and a pre-token came to is remembered. Any other text, and every text where the file's set-up is
    neither of the two known, goes through the whole tokenizer.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of 16 bits are asked for")
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = [k for k, parts in SET_UP.items() if all(file.get(c) == v for c, v in parts.items())]
        ends = {True: "</w>", False: None}
        model = {k: v for k, v in file["model"].items() if k not in ("vocab", "merges", "type", "end_of_word_suffix")}
        self.known = bool(kind) and file["model"]["type"] == "BPE" and file["model"].get("end_of_word_suffix") == ends[kind[0]] and not any(model.values()) and not file.get("post_processor")
        self.drops_space = self.known and kind[0]
        special = [] if plain_specials else [t["content"] for t in file["added_tokens"]]
        self.whole = re.compile("|".join([UNCOMMON.pattern, *map(re.escape, special)])) if self.known else re.compile("")
        self.letters = byte_letters()
        self.pieces = Bounded(self.merged)
        self.parts = Bounded(self.cut if self.drops_space else lambda part: self.cut(" " + part))

    def merged(self, piece: str) -> bytes:
        written = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(written)], "<u2").tobytes()

    def cut(self, text: str) -> bytes:
        found = SPACE_DROPS.findall(text.lower()) if self.drops_space else SPACE_LEADS.findall(text)
        return b"".join(map(self.pieces.__getitem__, found))

    def ids(self, text: str | None, end: int) -> np.ndarray:
        """The text's ids and the end id."""
        tail = np.array([end], "<u2")
        if not text:
            return tail
        if self.whole.search(text):
            return np.r_[np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2"), tail]
        if self.drops_space:
            made = b"".join(map(self.parts.__getitem__, text.split()))
        elif "  " in text or " \n" in text:  # a run of white space would be cut within
            made = self.cut(text)
        else:
            first, *parts = text.split(" ")
            made = self.cut(first) + b"".join(map(self.parts.__getitem__, parts))
        return np.frombuffer(made + tail.tobytes(), "<u2")


def encoder(path: str) -> PieceEncoder:
    """A worker's encoder: what it remembers serves its next tasks as well, until other work takes its place."""
    return kept(path, lambda: PieceEncoder(path))
