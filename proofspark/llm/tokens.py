"""Token ids of whole texts, inside tasks.

Texts are cut where their tokenizer cuts anyway, so that each piece is encoded once a task and looked up afterwards. The
ids are those of the whole text (tests compare them): pieces of Latin letters, with marks behind them or not, go straight
to the tokenizer's model, all others through the whole tokenizer, and texts with unusual white space are cut with care.
"""

from __future__ import annotations

import re

import numpy as np

#: Pieces remembered a task.
REMEMBERED = 800_000
#: Marks the first piece of a text, which has no space before it.
FIRST = "\x00"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([!-/:-@\\[-`{{-~]*)")
_INNER = re.compile(r"(?<=[^\s\x00-\x20\x7f-\xa0]) (?=[^\s\x00-\x20\x7f-\xa0])")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0]")


def spaced(text: str) -> list[str]:
    """Pieces, each but the first without its space, for a pre-tokenizer that joins one space to the word behind it."""
    usual = not ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " ") and text.replace("\n", "").isprintable()
    parts = text.split(" ") if usual else _INNER.split(text)
    parts[0] = FIRST + parts[0]
    return parts


def blank(text: str) -> list[str]:
    """Pieces for a tokenizer that drops white space."""
    return [FIRST + text] if _CONTROL.search(text) else text.split()


class Pieces(dict):
    """Row of each piece; pieces that are asked for the first time are noted in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        row = self[piece] = len(self)
        self.new.append(piece)
        return row


class Encoder:
    """Ids of texts by the tokenizers library. ``space``: the pre-tokenizer is byte-level and joins spaces to words."""

    def __init__(self, path: str, space: bool, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.space, self.cut = Tokenizer.from_file(path), space, spaced if space else blank
        self.model, self.remembered = self.tokenizer.model, remembered
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        usual = [chr(c) for c in range(32, 256) if chr(c) == " " or re.match(f"[{_LETTERS}]", chr(c))]
        self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in usual}
        self._forget()

    def _forget(self) -> None:
        self.known, self.marks = Pieces(), {}
        self.pool, self.used = np.empty(1 << 16, self.type), 0
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _ids(self, piece: str) -> list[int]:
        word = _PLAIN.fullmatch(piece)
        if word is None:
            return self.tokenizer.encode((" " if self.space and piece[:1] != FIRST else "") + piece.removeprefix(FIRST), add_special_tokens=False).ids
        letters = " " + word[1] if self.space else word[1].lower()
        ids = [x.id for x in self.model.tokenize(letters.translate(self.bytes))]
        if marks := word[2]:
            if marks not in self.marks:
                self.marks[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
            ids += self.marks[marks]
        return ids

    def _learn(self) -> None:
        rows = len(self.known) - len(self.known.new)
        tokenize, ids = self._ids, []
        sizes = np.empty(len(self.known.new), np.int64)
        for k, piece in enumerate(self.known.new):
            got = tokenize(piece)
            sizes[k] = len(got)
            ids += got
        end = self.used + len(ids)
        if len(self.pool) < end:
            self.pool = np.concatenate([self.pool, np.empty(2 * end, self.type)])
        if len(self.starts) < len(self.known):
            more = np.zeros(2 * len(self.known), np.int64)
            self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
        self.pool[self.used : end] = ids
        self.starts[rows : rows + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[rows : rows + len(sizes)] = sizes
        self.used = end
        self.known.new = []

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; a null text has none."""
        if len(self.known) > self.remembered:
            self._forget()
        look = self.known.__getitem__
        rows = [np.fromiter(map(look, parts), np.int64, len(parts)) for parts in (self.cut(x) if x else [] for x in texts)]
        if self.known.new:
            self._learn()
        out = []
        for r in rows:
            sizes = self.sizes[r]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(r) else 0
            out.append(self.pool[np.repeat(self.starts[r] - ends + sizes, sizes) + np.arange(total)])
        return out
