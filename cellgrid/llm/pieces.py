"""SentencePiece encoding that keeps track of where in the original text each piece comes from.

A text is normalised by the model's own rules: at every place the longest key of its compiled character map
is replaced, and each character that comes out keeps the range it came from.  Pieces are then found by the
library in the normalised text, and their lengths lead back to byte ranges of the original.  Where no piece
crosses the place before a mark, the library is asked once for each word, as most words come again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgrid.llm.tokens import vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Characters of a block that a longer text is cut into, before a space, and the last character before the cut.
BLOCK_CHARS = 1 << 20
BEFORE_SPACE = re.compile(f"[^ {MARK}][ {MARK}]")
# A word with the marks before it, and characters of words whose ids a worker keeps at most, but for the latest block's.
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KEPT_CHARS = 1 << 21
# Field numbers of the public model format, and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol buffer; whole numbers as such, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """A model's compiled map: a double-array trie of UTF-8 keys, and the texts that replace them."""

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.texts = compiled[4 + size :]
        self.starts: dict[str, bool] = {}

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit >> 6) & 8)

    def longest(self, key: bytes) -> tuple[int, str] | None:
        """Bytes of the longest prefix of ``key`` that the map holds, and its replacement."""
        found, node = None, self._offset(self.units[0])
        for n, byte in enumerate(key, 1):
            node ^= byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = n, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])].decode()

    def may_start(self, char: str) -> bool:
        """Whether some key starts with a character."""
        if char not in self.starts:
            node, alive = self._offset(self.units[0]), True
            for byte in char.encode():
                node ^= byte
                unit = self.units[node]
                if unit & 0x800000FF != byte:
                    alive = False
                    break
                node ^= self._offset(unit)
            self.starts[char] = alive
        return self.starts[char]

    def replaced(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The text with longest keys replaced from the left; for each character the range of characters it came from."""
        alive = "".join(filter(self.may_start, sorted(set(text))))
        if not alive:
            return _as_is(text)
        out, begins, ends, done, longest_key = [], [], [], 0, 64

        def keep(upto: int) -> None:
            out.append(text[done:upto])
            begins.append(np.arange(done, upto, dtype=np.int32))
            ends.append(np.arange(done + 1, upto + 1, dtype=np.int32))

        for m in re.finditer(f"[{re.escape(alive)}]", text):
            at = m.start()
            if at < done or (hit := self.longest(text[at : at + longest_key].encode())) is None:
                continue
            keep(at)
            upto = at + len(text[at : at + longest_key].encode()[: hit[0]].decode())
            out.append(hit[1])
            begins.append(np.full(len(hit[1]), at, np.int32))
            ends.append(np.full(len(hit[1]), upto, np.int32))
            done = upto
        keep(len(text))
        return "".join(out), np.concatenate(begins), np.concatenate(ends)


def _as_is(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    places = np.arange(len(text) + 1, dtype=np.int32)
    return text, places[:-1], places[1:]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 byte where each character, and the end, is; and the character that each byte is in."""
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    return np.append(np.flatnonzero(lead), len(lead)).astype(np.int32), np.cumsum(lead, dtype=np.int32) - 1


class Encoder:
    """A model file: its normaliser, with alignment, and its pieces."""

    def __init__(self, path: str) -> None:
        model = Path(path).read_bytes()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        rules, trainer, texts, kinds = {}, {}, [], []
        for field, value in proto_fields(model):
            if field == PIECES:
                piece = dict(proto_fields(value))
                texts.append(piece[1].decode())
                kinds.append(piece.get(3, 1))
            elif field == NORMALIZER:
                rules |= dict(proto_fields(value))
            elif field == TRAINER:
                trainer |= dict(proto_fields(value))
        if trainer.get(24, 0) or rules.get(5, 1) == 0:
            raise ValueError("models whose marks end words, or that keep spaces, are not supported")
        self.map = CharacterMap(rules[2]) if rules.get(2) else None
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        # fields given again replace earlier ones: the same model, for texts that are normalised already
        plain = b"\x12\x00\x18\x00\x20\x00\x28\x00"
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(plain)]) + plain)
        self.widths = np.array([1 if k == BYTE else len(t.encode()) for t, k in zip(texts, kinds, strict=True)], np.int32)
        self.unknown = np.array(kinds) == UNKNOWN
        # merges don't cross the place before a mark if no piece has a mark behind another character
        usual = [t for t, k in zip(texts, kinds, strict=True) if k not in (CONTROL, UNKNOWN, BYTE)]
        crossing = USER in kinds or any(re.search(f"[^{MARK}]{MARK}", t) for t in usual)
        self.in_blocks = not (crossing or self.map or self.squeeze)
        self.by_word = self.in_blocks and MARK in usual
        # bytes of the original that a piece covers where all marks were spaces
        self.spaced = np.array([1 if k == BYTE else len(t.replace(MARK, " ").encode()) for t, k in zip(texts, kinds, strict=True)], np.int32)
        # pieces that start, and that end, with a mark
        self.marked, self.open = np.array([t.startswith(MARK) for t in texts]), np.array([t.endswith(MARK) for t in texts])
        self.words: dict[str, bytes] = {}
        self.kept = 0

    def normalised(self, text: str, first: bool = True) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, and for each of its characters the range of the text's characters it came from.

        A mark put before the text came from nothing: its range is empty.
        """
        out, begins, ends = self.map.replaced(text) if self.map else _as_is(text)
        if self.squeeze and out:
            space = _code_points(out) == ord(" ")
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            if keep.any() and space[last := int(np.flatnonzero(keep)[-1])]:
                keep[last] = False
            out, begins, ends = _code_points(out)[keep].tobytes().decode("utf-32-le"), begins[keep], ends[keep]
        if not out:
            return "", begins[:0], ends[:0]
        if self.prefix and first:
            out, begins, ends = f" {out}", np.append(begins[:1], begins), np.append(begins[:1], ends)
        return out.replace(" ", MARK), begins, ends

    def _pieces(self, norm: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a normalised text, and the bytes that each covers."""
        ids = self.inner.encode(norm, return_type="numpy")
        if not self.unknown[ids].any():
            return ids, self.widths[ids]
        # what an unknown piece covers is not in the vocabulary
        return ids, np.array([len(p.surface.encode()) for p in self.inner.encode(norm, return_type="proto").pieces], np.int32)

    def _learn(self, new: set[str]) -> None:
        """Keep the ids of words; those that start with a mark and end without one go to the library as one text."""
        joint = [w for w in new if w[0] == MARK and w[-1] != MARK]
        ids = self.inner.encode("".join(joint), return_type="numpy").astype(np.int32)
        if joint and not self.unknown[ids].any():
            cuts = (4 * (np.flatnonzero(self.marked[ids[1:]] & ~self.open[ids[:-1]]) + 1)).tolist()
            if len(cuts) + 1 != len(joint):
                raise AssertionError("a piece crosses the place before a mark")
            data = ids.tobytes()
            self.words.update(zip(joint, [data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)], strict=True)], strict=True))
        for w in new.difference(self.words):
            self.words[w] = self.inner.encode(w, return_type="numpy").astype(np.int32).tobytes()
        self.kept += sum(map(len, new))

    def _word_ids(self, norm: str) -> np.ndarray:
        """Ids of a normalised text, word by word."""
        if self.kept > KEPT_CHARS:
            self.words, self.kept = {}, 0
        words = WORD.findall(norm)
        if new := set(words).difference(self.words):
            self._learn(new)
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def _block(self, text: str, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block of text, and the bytes of it where each begins and ends."""
        if text and self.by_word and MARK not in text:
            ahead = self.prefix and first
            ids = self._word_ids(f"{MARK if ahead else ''}{text.replace(' ', MARK)}")
            if not self.unknown[ids].any():
                high = np.cumsum(self.spaced[ids], dtype=np.int32) - np.int32(ahead)
                if high[-1] != len(text.encode()):
                    raise AssertionError("the pieces don't cover the text")
                return ids, np.append(np.int32(0), high[:-1]), high
        norm, begins, ends = self.normalised(text, first)
        if not norm:
            return (np.zeros(0, np.int32),) * 3
        ids, size = self._pieces(norm)
        starts, char_of = _characters(norm)
        origin, _ = _characters(text)
        upto = np.cumsum(size, dtype=np.int32)
        if upto[-1] != starts[-1]:
            raise AssertionError("the pieces don't cover the normalised text")
        # the characters that a piece's first and last byte are in, and how far into them
        head, tail = char_of[upto - size], char_of[upto - 1]
        low, high = origin[begins], origin[ends]
        same = high - low == np.diff(starts)
        into, left = upto - size - starts[head], starts[tail + 1] - upto
        return ids, low[head] + np.where(same[head], into, 0), high[tail] - np.where(same[tail], left, 0)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the original bytes where each begins and ends, for a text of any length (null: empty).

        The bytes of a character that is written as byte pieces are told apart; where several pieces come from
        one replaced key, each has the key's whole range.
        """
        text, parts, at, moved = text or "", [], 0, 0
        while at < len(text) or not parts:
            upto = len(text)
            if upto - at > BLOCK_CHARS and self.in_blocks:
                cut = BEFORE_SPACE.search(text, at + BLOCK_CHARS)
                upto = cut.start() + 1 if cut else upto
            block = text[at:upto]
            ids, low, high = self._block(block, at == 0)
            parts.append((ids, low + moved, high + moved))
            at, moved = upto, moved + len(block.encode())
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(text: Column, model: str = MODEL, end_id: bool = True) -> Column:
    """Struct of a text's ``ids`` and of the bytes where each piece begins and ends, from the text's start.

    A null text counts as empty; an empty text has no pieces.  The end id, if asked for, has an empty range.
    """

    @F.pandas_udf("ids array<int>, begins array<int>, ends array<int>")
    def of(texts: pd.Series) -> pd.DataFrame:
        e, rows = encoder(vocabulary(model)), []
        for t in texts:
            ids, low, high = e.encode(t)
            if end_id:
                size = len((t or "").encode())
                ids, low, high = np.append(ids, e.library.eos_id()), np.append(low, size), np.append(high, size)
            rows.append((ids.astype(np.int32), low.astype(np.int32), high.astype(np.int32)))
        return pd.DataFrame(rows, columns=["ids", "begins", "ends"])

    return of(text)


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of a list of ids, as the library gives it (null: as no ids)."""

    @F.pandas_udf("string")
    def of(lists: pd.Series) -> pd.Series:
        library = encoder(vocabulary(model)).library
        return pd.Series([library.decode(np.zeros(0, np.int32) if x is None else x) for x in lists], dtype=object)

    return of(ids)
