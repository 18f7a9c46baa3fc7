"""Pre-tokens of byte-level BPE files: class boundaries of whole batches of texts, found with numpy."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import pre_tokenizers

#: Pre-token pattern of byte-level BPE as published with the public vocabularies (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Endings that the pattern cuts off after an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = range(4)
PROBED = 4_096


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The pattern's class of every code point, as the library sees it.

    Classes come from the regex module; code points it knows and Python's older Unicode tables do not are asked from the
    library itself, whose tables lie between the two.
    """
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    text, out = points.tobytes().decode("utf-32-le"), np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    late = [c for c in np.flatnonzero(out != OTHER).tolist() if unicodedata.category(chr(c)) == "Cn"]
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for k in range(0, len(late), PROBED):
        part = late[k : k + PROBED]
        cuts = {a for _, (a, _) in library.pre_tokenize_str("".join(f"a{chr(c)}1!{chr(c)}!\n" for c in part))}
        for i, c in enumerate(part):
            at = 7 * i  # joins the letter before it, or the digit after it, or splits the signs around it
            out[c] = LETTER if at + 1 not in cuts else NUMBER if at + 2 not in cuts else SPACE if at + 4 in cuts else OTHER
    return out


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; ``first`` marks where texts start, which never share one.

    Runs of a class are pre-tokens. The last of white space before something else goes to that if it is a blank, and is
    a pre-token of its own if not. An apostrophe that no blank joins takes a known ending off the letters after it.
    """
    n = len(points)
    kind = classes()[points]
    start = np.ones(n + 3, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | first[1:]
    edge = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
    start[edge] = True
    start[edge[points[edge] == 0x20] + 1] = False
    near = np.zeros(n + 3, np.uint32)
    near[:n] = points
    fresh = np.ones(n + 3, bool)
    fresh[:n] = first
    mark = np.flatnonzero((points == 0x27) & start[:n])
    for ending in ENDINGS:
        hit = mark
        for k, c in enumerate(ending, 1):
            hit = hit[(near[hit + k] == ord(c)) & ~fresh[hit + k]]
        start[hit + 1] = False
        start[hit + len(ending) + 1] = True
    return start[:n]


class PreTokenizer:
    """Splits texts as a byte-level BPE file's added tokens and pre-tokenizer do; other kinds of file are refused."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        pre, added = self.file["pre_tokenizer"] or {}, self.file["added_tokens"]
        if self.file["normalizer"] is not None or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{path} does not split texts by the byte-level pattern alone")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"] for t in added):
            raise ValueError(f"{path} has added tokens that take in white space or need word bounds")
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if added else None

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text in pieces, each with whether it is an added token's string."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all texts in order, and how many each text has. A piece that equals an added token's string is
        that token: such strings are cut out before, so no pre-token can contain one."""
        parts, ends, special, n = [], [], [], 0
        for t in texts:
            for part, is_special in self.segments(t):
                if is_special:
                    special.append((n, n + len(part)))
                parts.append(part)
                n += len(part)
            ends.append(n)
        if not n:
            return [], np.zeros(len(texts), np.int64)
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        first = np.zeros(n, bool)
        first[np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]] = True
        start = boundaries(points, first)
        for a, b in special:
            start[a + 1 : b] = False
        at = np.flatnonzero(start)
        counts = np.diff(np.searchsorted(at, ends), prepend=0)
        cuts = [*at.tolist(), n]
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])], counts  # noqa: B905  one cut more than pieces
