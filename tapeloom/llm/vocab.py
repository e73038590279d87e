"""Exact, cached use of public tokenizer files."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable

import numpy as np

from tapeloom.llm.bytesets import SPACE, Rolling, spans

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept in a worker's index before it starts afresh.
CACHE_ENTRIES = 600_000
#: Letters of one code point that are in normal form C already; U+0130 lower-cases to two.
_PLAIN_BELOW = "ɐ"


def tokenizer(path: str):
    """The library's tokenizer, truncation and padding off."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free from 256."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in kept else next(rest)) for b in range(256)]


def drops_space(spec: dict) -> bool:
    """Whether white space only separates: the pre-tokenizer keeps none of it, so texts may be cut at any ASCII white space."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = pre[0]
    return split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and "\\s" in split["pattern"].get("Regex", "") and norm == ["NFC", "Replace", "Lowercase"] and not any(x["lstrip"] or x["rstrip"] or set(x["content"]) & set(" \t\n\r\x0b\x0c") for x in spec.get("added_tokens", []))


class PieceIndex:
    """Token ids by piece of text, bounded: pieces are found by hash, and only new ones are encoded.

    Every step but the encoding of new pieces is done on whole arrays. When more than CACHE_ENTRIES pieces are held,
    the index starts afresh.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]]):
        self.learn = learn
        self._clear()

    def _clear(self) -> None:
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids begin in self.flat, and how many they are; valid until the next call."""
        if len(self.hash) > CACHE_ENTRIES:
            self._clear()
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, first, back = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, key)
        new = np.ones(len(key), bool)
        inside = at < len(self.hash)
        new[inside] = self.hash[at[inside]] != key[inside]
        if new.any():
            raw = data.tobytes()
            got = self.learn([raw[i:j] for i, j in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            n = np.fromiter(map(len, got), np.int64, len(got)) // 4
            ids = np.frombuffer(b"".join(got), "<u4")
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            where = at[new]
            self.hash = np.insert(self.hash, where, key[new])
            self.at = np.insert(self.at, where, self.used + np.cumsum(n) - n)
            self.n = np.insert(self.n, where, n)
            self.used += len(ids)
            at = at + np.cumsum(new) - new
        return self.at[at][back], self.n[at][back]

    def ids(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The pieces' ids end to end."""
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(n) else 0) + np.repeat(at - ends + n, n)]


class _Words:
    """Ids of white-space-free pieces by the library."""

    def __init__(self, tok):
        self.tok, self.model = tok, tok.model
        self.letter = dict(enumerate(byte_letters()))
        self.end = {c: self._plain(c) for c in ".,"}

    def _plain(self, low: str) -> bytes:
        """Ids of one pre-token, lower-cased: straight from the library's model, without its normalizer."""
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.letter)
        return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        out, cores = [], {}
        for piece in pieces:
            text = piece.decode()
            core, last = (text[:-1], text[-1]) if text[-1] in ".," else (text, "")
            if core.isalpha() and max(core) < _PLAIN_BELOW and "İ" not in core:
                core = core.lower()
                if core not in cores:
                    cores[core] = self._plain(core)
                out.append(cores[core] + self.end[last] if last else cores[core])
            else:
                out.append(array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes())
        return out


class Encoder:
    """Token ids or counts of whole texts, equal to the library's; cut at ASCII white space where that is safe."""

    def __init__(self, path: str):
        self.pieces = None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            whole = SentencePieceProcessor(model_file=path)
            self.whole = lambda text: whole.encode(text, num_threads=1)
        else:
            tok = tokenizer(path)
            self.whole = lambda text: tok.encode(text, add_special_tokens=False).ids
            with open(path) as f:
                if drops_space(json.load(f)):
                    self.pieces = PieceIndex(_Words(tok))

    def encode(self, data: np.ndarray, offs: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows' texts end to end (none if ids is false), and each row's number of them."""
        if self.pieces is None:
            got = [np.array(self.whole(data[i:j].tobytes().decode()), np.uint32) for i, j in zip(offs[:-1], offs[1:], strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)
        starts, ends, row = spans(data, offs, ~SPACE)
        at, n = self.pieces.find(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(n)])
        return self.pieces.ids(at, n) if ids else np.zeros(0, np.uint32), np.diff(total[row])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process; its index outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
