"""Reads public tokenizer files into plain tables that tasks can share.

The path of the file is always a parameter. A model holds only the vocabulary, so its size is bounded by the
file (under 2 MB here); it is broadcast once per session and file.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the public split pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int32(2**31 - 1)
LONG_WORD = 96


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the rest moves to U+0100 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


#: Letters and numbers of newer Unicode versions that the library's split still takes for unassigned.
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: First and last capital, and the first small letter, of pairs that the library knows and Python doesn't yet.
LATER_CAPITALS = (
    "1C89-1C89=1C8A A7CB-A7CB=264 A7CC-A7CC=A7CD A7CE-A7CE=A7CF A7D2-A7D2=A7D3 A7D4-A7D4=A7D5 A7DA-A7DA=A7DB A7DC-A7DC=19B "
    "10D50-10D65=10D70 16EA0-16EB8=16EBB"
)

#: Combining marks of newer Unicode versions that don't move or compose in the library's normal form.
LATER_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 "
    "10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 "
    "16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def char_class(text: str) -> str:
    """The character class of a list of code points and ranges in hexadecimal."""
    ranges = (r.split("-") for r in text.split())
    return "[" + "".join(f"\\U{int(r[0], 16):08x}-\\U{int(r[-1], 16):08x}" for r in ranges) + "]"


#: The least code point of all these lists; a text below it needs none of them.
FIRST_LATER = "\u0558"
_LATER_SIGNS = regex.compile(char_class(f"{LATER_LETTERS} {LATER_NUMBERS}"))
_BARRIER = regex.compile("(" + char_class(LATER_MARKS) + ")")


def composed(text: str) -> str:
    """NFC as the library has it: LATER_MARKS stand where they are, and what is around them is composed apart."""
    if max(text, default="") < FIRST_LATER or not _BARRIER.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in _BARRIER.split(text))


def of_the_library(pattern: str) -> str:
    """`pattern` with classes of letters and numbers as the library's Unicode version has them."""
    own = {f"\\p{{{name}}}": f"[\\p{{{name}}}--{char_class(text)}]" for name, text in (("L", LATER_LETTERS), ("N", LATER_NUMBERS))}
    return regex.sub(r"\\p\{[LN]\}", lambda m: own[m[0]], pattern)


@lru_cache(maxsize=1)
def later_capitals() -> dict[int, int]:
    """Small letters of LATER_CAPITALS, for str.translate."""
    out = {}
    for part in LATER_CAPITALS.split():
        span, small = part.split("=")
        first, last = (int(x, 16) for x in span.split("-"))
        out.update(zip(range(first, last + 1), range(int(small, 16), int(small, 16) + last - first + 1), strict=True))
    return out


_LATER = frozenset(map(chr, later_capitals()))


@dataclass
class BpeModel:
    """Vocabulary, merges and text rules of one tokenizer file."""

    tokens: list[str]
    specials: dict[str, int]
    pattern: str
    suffix: str
    normalizers: list[tuple]
    byte_level_decoder: bool
    first: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte at the end of a word
    pair_keys: np.ndarray  # left id * width + right id, ascending
    pair_rank: np.ndarray
    pair_id: np.ndarray
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_made": {}}

    @property
    def width(self) -> int:
        return len(self.tokens)

    def split_specials(self, text: str) -> list[str]:
        """Text and special strings by turns; special strings sit at the odd places."""
        if "special" not in self._made:
            names = sorted(self.specials, key=len, reverse=True)
            self._made["special"] = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        found = self._made["special"]
        return [text] if found is None or not any(s in text for s in self.specials) else found.split(text)

    def normalize(self, text: str) -> str:
        for kind, *args in self.normalizers:
            if kind == "NFC":
                text = composed(text)
            elif kind == "Lowercase":
                # one character at a time: the library knows no final sigma
                text = text.replace("Σ", "σ").lower()
                if max(text, default="") >= FIRST_LATER and not _LATER.isdisjoint(text):
                    text = text.translate(later_capitals())
            else:
                text = regex.sub(args[0], args[1], text)
        return text

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text that holds no special string."""
        if "pattern" not in self._made:
            self._made["pattern"] = regex.compile(self.pattern), regex.compile(of_the_library(self.pattern), regex.V1)
        text, (plain, exact) = self.normalize(text), self._made["pattern"]
        later = max(text, default="") >= FIRST_LATER and _LATER_SIGNS.search(text)
        return (exact if later else plain).findall(text)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the merge table, or -1."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), at, -1)


@lru_cache(maxsize=4)
def load_model(path: str) -> BpeModel:
    """Reads a `tokenizers` BPE file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre = data["model"], data["pre_tokenizer"]
    vocab: dict[str, int] = model["vocab"]
    specials = {t["content"]: t["id"] for t in data["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *specials.values()]) + 1)
    for text, i in [*vocab.items(), *specials.items()]:
        tokens[i] = text
    suffix = model.get("end_of_word_suffix") or ""
    steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
    split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL_PATTERN)
    rules = data["normalizer"] or {"normalizers": []}
    normalizers = []
    for rule in rules.get("normalizers", [rules]):
        normalizers.append(("Replace", rule["pattern"]["Regex"], rule["content"]) if rule["type"] == "Replace" else (rule["type"],))
    alphabet = byte_alphabet()
    first = np.array([vocab[c] for c in alphabet], np.int32)
    last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
    key, made = left * len(tokens) + right, np.array([vocab[a + b] for a, b in merges], np.int32)
    order = np.argsort(key, kind="stable")
    return BpeModel(tokens, specials, split, suffix, normalizers, bool(data["decoder"]), first, last, key[order], order.astype(np.int32), made[order])
