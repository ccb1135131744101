"""Token ids by a public tokenizer file, with a bounded cache of pre-tokens.

A text is cut into pre-tokens by the tokenizer's own pattern, so the ids of the
pre-tokens make up the text's; those that are new are encoded many at a time.
Texts with characters on whose class or case libraries may differ are encoded in
one piece.
"""

from __future__ import annotations

import re

import numpy as np

#: A worker's cache has two generations of at most so many pre-tokens each.
KEPT = 500_000
#: Anything but plain white space, ASCII and the Latin letters and marks up to U+024F, without number forms and the dotted capital I; or the start of a special token.
ODD = re.compile("[^\t\n\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]|<\\|")
_PLAIN = b"\t\n\r" + bytes(range(32, 127))
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f\u2c65\u2c66"
_REST = f"[^{_LETTER}0-9 \t\n\r]+"
#: The pre-tokens of a text of plain characters.
PIECES = {
    "byte": re.compile(f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?{_REST}|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+").findall,
    "word": re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|{_REST}").findall,
}
#: Pre-tokens encoded in one text.
TOGETHER = 64

_open: dict[tuple[str, str], "Encoder"] = {}


def odd(text: str) -> bool:
    """Has ``text`` anything that ``ODD`` finds? Plain characters are dropped first, which takes a byte each, not a step of a search."""
    rest = text.encode().translate(None, _PLAIN)
    return "<|" in text or bool(rest) and ODD.search(rest.decode()) is not None


class Cache:
    """Two generations: when the young one is full it becomes the old one; what is found there returns."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lacking(self, wanted: set[str]) -> set[str]:
        """Which of ``wanted`` are in neither; the others are in the young generation afterwards."""
        young = self.young
        out = {c for c in wanted if c not in young}
        if len(young) + len(out) > self.size:
            self.old, self.young = young, {}
            young, out = self.young, set(wanted)
        old = self.old
        for c in [c for c in out if c in old]:
            young[c] = old[c]
            out.discard(c)
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``kind``: "byte" (byte-level, a space belongs to the word after it) or "word"
    (lower case, white space dropped, words end in a mark).
    """

    def __init__(self, path: str, kind: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.kind, self.cut = kind, PIECES[kind]
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        if kind == "byte":
            # the only space of a pre-token is its first character
            self.edge[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        else:
            # pre-tokens come lower-cased and cut; only the model's part is left to do
            self.parts.normalizer = None
            self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.edge[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pieces = Cache(KEPT)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, fresh: list[str]) -> None:
        into = self.pieces.young
        if self.kind == "byte":
            alone = [p for p in fresh if p[0] != " " or len(p) < 2 or p[1].isspace()]
            for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
                into[p] = np.array(e.ids, "<u4").tobytes()
            fresh = [p for p in fresh if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        groups = [fresh[i : i + TOGETHER] for i in range(0, len(fresh), TOGETHER)]
        texts = ["".join(g) if self.kind == "byte" else " ".join(g) for g in groups]
        for g, e in zip(groups, self.parts.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            stops = [*at[1:].tolist(), len(ids)] if self.kind == "byte" else (at + 1).tolist()
            if len(stops) != len(g):
                raise ValueError("pre-tokens and ids don't match")
            raw, a = ids.tobytes(), 0
            for p, b in zip(g, stops, strict=True):
                into[p] = raw[4 * a : 4 * b]
                a = b

    def _known(self, cut: list[str]) -> bytes | None:
        """The ids of a cut text, or None if a pre-token of it isn't in the young generation."""
        try:
            return b"".join(map(self.pieces.young.__getitem__, cut))
        except KeyError:
            return None

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 64):
            part = texts[i : i + 64]
            cut = [None if odd(t) else self.cut(t.lower() if self.kind == "word" else t) for t in part]
            made = [self.whole(t) if c is None else self._known(c) for t, c in zip(part, cut, strict=True)]
            if fresh := [k for k, m in enumerate(made) if m is None]:
                self._encode(list(self.pieces.lacking(set().union(*[cut[k] for k in fresh]))))
                for k in fresh:
                    made[k] = self._known(cut[k])
            out += made
        return out


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder for a file."""
    if (path, kind) not in _open:
        _open[path, kind] = Encoder(path, kind)
    return _open[path, kind]
