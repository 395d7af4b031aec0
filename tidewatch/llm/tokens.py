"""Token ids of whole texts, by a public tokenizer's file."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space, which ends a piece.
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True

#: Encoders of this Python worker, by file.
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder for a tokenizer file, one per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The pieces of all texts, each with a space behind, and how many there are up to each text's end."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    gap = _GAPS[raw]
    closes = np.empty(len(gap), bool)           # the first gap behind a piece
    closes[:1], closes[1:] = False, gap[1:] & ~gap[:-1]
    keep = ~gap | closes
    letters, closed = raw[keep], closes[keep]
    letters[closed] = 32
    offsets = np.append(0, np.flatnonzero(closed) + 1).astype(np.int32)
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    pieces = pa.BinaryArray.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return pieces, np.searchsorted(np.flatnonzero(closes), stops, side="right")


class Encoder:
    """Ids of texts, equal to the tokenizer's own without special tokens.

    A tokenizer whose words end in a suffix drops white space and encodes every piece between
    it by itself, so the ids of pieces met before are looked up, for the distinct pieces of about
    ``letters`` bytes of texts at a time. About ``most`` pieces are kept, and as many that were met
    before those. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, most: int = 300_000, letters: int = 1 << 22):
        # Spark's tasks are the parallel part: threads of the library's own would share their cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.letters = most, letters
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        self.pieces: dict[str, bytes] = {"": b""}
        self.former: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``dtype``."""
        if self.ends is None:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(x.ids, self.dtype).tobytes() for x in found]
        out, part, size = [], [], 0
        for text in texts:
            part.append(self._plain(text))
            size += len(part[-1])
            if size >= self.letters:
                out += self._looked_up(part)
                part, size = [], 0
        return out + self._looked_up(part) if part else out

    def _looked_up(self, texts: list[bytes]) -> list[bytes]:
        """All steps go over a batch of texts or its distinct pieces, none over its words."""
        pieces, ends = _pieces(texts)
        coded = pieces.dictionary_encode()
        distinct = pc.binary_slice(coded.dictionary, 0, -1).cast(pa.string()).to_numpy(zero_copy_only=False).tolist()
        if len(self.pieces) > self.most:
            self.former, self.pieces = self.pieces, {"": b""}
        found = list(map(self.pieces.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        former, new = self.former, []
        for piece in map(distinct.__getitem__, missing):
            ids = former.get(piece)
            if ids is None:
                new.append(piece)
            else:
                self.pieces[piece] = ids
        self._learn(new)
        for i in missing:
            found[i] = self.pieces[distinct[i]]
        # Taken by piece, the ids of all texts lie one behind the other.
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, raw = ids.buffers()
        store = memoryview(raw if raw is not None else b"")
        cuts = np.frombuffer(offsets, np.int64)[ends].tolist()
        return [store[i:j].tobytes() for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _plain(self, text: str) -> bytes:
        # The tokenizer drops case itself; doing so before makes fewer pieces. Where that might
        # not come to the same (special tokens, final sigma, marks to compose), it is left alone.
        if "<|" not in text:
            if text.isascii():
                text = text.lower()
            elif "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
                lower = text.lower()
                if unicodedata.is_normalized("NFC", lower):
                    text = lower
        return text.encode()

    def _learn(self, new: list[str]) -> None:
        """Letters with a full stop or comma behind are two words of the tokenizer."""
        words, ended, single = set(), [], []
        for piece in new:
            if piece.isalpha():
                words.add(piece)
            elif piece[-1] in ".," and piece[:-1].isalpha():
                ended.append(piece)
            else:
                single.append(piece)
        for stem in {piece[:-1] for piece in ended}.difference(self.pieces):
            ids = self.former.get(stem)
            if ids is None:
                words.add(stem)
            else:
                self.pieces[stem] = ids
        self._encode_words(list(words))
        self._encode_each([*single, *{".", ","}.difference(self.pieces)])
        pieces = self.pieces
        pieces.update({piece: pieces[piece[:-1]] + pieces[piece[-1]] for piece in ended})

    def _encode_each(self, pieces: list[str]) -> None:
        for piece, x in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.pieces[piece] = np.array(x.ids, self.dtype).tobytes()

    def _encode_words(self, words: list[str], at_once: int = 512) -> None:
        """Runs of words as one text each; the suffix tells where a word's ids end."""
        groups = [words[k:k + at_once] for k in range(0, len(words), at_once)]
        found = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, x in zip(groups, found, strict=True):
            ids = np.array(x.ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                self._encode_each(group)
                continue
            raw, width, begin = ids.tobytes(), self.dtype.itemsize, 0
            for word, end in zip(group, ends.tolist(), strict=True):
                self.pieces[word] = raw[begin * width:end * width]
                begin = end
