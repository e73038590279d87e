"""Byte-level BPE as a transducer with bounded lookahead.

A merge list fixes how far to the right a token can depend on text that is still to come (`lookahead`). The encoder
holds one block and that margin of a pre-token, merges it, and emits the tokens that end before the margin: they are
the same whatever follows. So memory is constant however long a run of letters is. Many pre-tokens advance in step,
a row each of one matrix. The decoder turns ids into text with an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.bytesets import SPACE, groups, text_bytes
from tapeloom.llm.vocab import PieceIndex, byte_letters

#: Fixed value of byte-level vocabularies: how a text falls into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII before ASCII white space: there a piece's border may lie inside a pre-token.
_MIXED = re.compile(rb"(?:[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[ \t\n\r\x0b\x0c]")
BLOCK = 256
#: Pre-tokens merged in step, and cells of their matrix.
ROWS, CELLS = 8192, 1 << 18
#: Bits for a place in a row, and what stands for no pair.
PLACE, NONE = 12, np.int32(2**31 - 1)
BATCH_BYTES = 2 << 20


def pieces_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII white space with what follows them: each border before white space is a pre-token's, in any context."""
    white = SPACE[data]
    first = np.zeros(len(data), bool)
    first[1:] = white[1:] & ~white[:-1]
    first[offs[:-1][offs[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, offs)


class Transducer:
    """Encoder and decoder of a byte-level BPE file (merges whose parts are made by earlier merges, no prefix space)."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.first = np.array([vocab[c] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = max(vocab.values()) + 1
        order = np.argsort(left * self.size + right)
        self.keys = (left * self.size + right)[order]
        self.rank, self.made = order.astype(np.int32), made.astype(np.int32)
        self.lookahead = sufficient_lookahead(left.tolist(), right.tolist(), made.tolist(), {i: len(t) for t, i in vocab.items()}, set(self.first.tolist()))
        added = {x["id"]: x["content"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with flags")
        if BLOCK + self.lookahead >= 1 << PLACE or len(pairs) >= 1 << (31 - PLACE):
            raise ValueError(f"{path}: more merges or a longer lookahead than a key holds")
        self.added = {c.encode(): i for i, c in added.items()}
        self.split_added = re.compile("(" + "|".join(re.escape(c) for c in sorted(added.values(), key=len, reverse=True)) + ")") if added else None
        self.bytes_of: list[bytes] = [b""] * max(self.size, max(added, default=-1) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        for i, c in added.items():
            self.bytes_of[i] = c.encode()
        self.pre = regex.compile(PRE_TOKENS)
        self.pieces = PieceIndex(self._learn)

    # -- merging, a matrix of pre-tokens at a time

    def _order(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair and its place in one number, or NONE."""
        key = a.astype(np.int64) * self.size + b
        found = np.searchsorted(self.keys, key)
        found[found == len(self.keys)] = 0
        return np.where((self.keys[found] == key) & (a >= 0) & (b >= 0), self.rank[found] << PLACE | at, NONE)

    def merge(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token ids, -1 between them, of columns of bytes (row k: the k-th byte of each) after all merges.

        Of each column, the pair of lowest rank merges first, the leftmost of equals; neighbours are linked by index.
        """
        w, n = raw.shape
        place = np.arange(w, dtype=np.int32)[:, None]
        ids = np.full((w + 2, n), -1, np.int32)
        ids[:w] = np.where(place < size, self.first[raw], np.int32(-1))
        out, live = ids[:w].copy(), np.arange(n)
        nxt = np.tile(np.minimum(np.arange(1, w + 3), w)[:, None].astype(np.int32), (1, n))
        prv = np.tile(np.where(np.arange(w + 2) > 0, np.arange(w + 2) - 1, w + 1)[:, None].astype(np.int32), (1, n))
        key = np.full((w + 2, n), NONE, np.int32)
        if w > 1:
            key[: w - 1] = self._order(ids[: w - 1].ravel(), ids[1:w].ravel(), np.repeat(np.arange(w - 1, dtype=np.int32), n)).reshape(w - 1, n)
        while True:
            best = key[:w].min(0) if w else np.zeros(0, np.int32)
            on = np.flatnonzero(best < NONE)
            if 2 * len(on) < len(live) or not len(on):
                out[:, live] = ids[:w]
                if not len(on):
                    return out
                live, best = live[on], best[on]
                ids, nxt, prv, key = ids[:, on], nxt[:, on], prv[:, on], key[:, on]
                on = np.arange(len(on))
            else:
                best = best[on]
            at, new = best & ((1 << PLACE) - 1), self.made[best >> PLACE]
            gone = nxt[at, on]
            after, before = nxt[gone, on], prv[at, on]
            ids[at, on], ids[gone, on], key[gone, on] = new, -1, NONE
            nxt[at, on], prv[after, on] = after, at
            key[at, on] = self._order(new, ids[after, on], at)
            key[before, on] = self._order(ids[before, on], new, before)

    def _rows(self, bufs: list[bytes], w: int) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of all pieces end to end, and each piece's offsets in them."""
        raw = np.frombuffer(b"".join([x.ljust(w, b"\0") for x in bufs]), np.uint8).reshape(len(bufs), w)
        size = np.fromiter(map(len, bufs), np.int64, len(bufs))
        got = np.ascontiguousarray(self.merge(np.ascontiguousarray(raw.T), size).T)
        on = got >= 0
        return got[on].astype("<u4"), np.concatenate([[0], np.cumsum(on.sum(1))])

    def _streams(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token: short ones in one step, long ones block by block with the lookahead held back."""
        out = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        room = BLOCK + self.lookahead
        order = np.argsort(size, kind="stable")
        short = order[: int(np.searchsorted(size[order], room, "right"))]
        lo = 0
        while lo < len(short):
            hi = min(lo + ROWS, len(short))
            while (hi - lo) * size[short[hi - 1]] > CELLS and hi - lo > 1:
                hi = lo + (hi - lo) // 2
            part, lo = short[lo:hi].tolist(), hi
            flat, at = self._rows([pieces[k] for k in part], max(1, int(size[part[-1]])))
            raw, at = flat.tobytes(), (at * 4).tolist()
            for j, k in enumerate(part):
                out[k] = raw[at[j] : at[j + 1]]
        state = [(int(k), 0) for k in order[len(short) :]]
        done: dict[int, list[bytes]] = {k: [] for k, _ in state}
        while state:
            later = []
            for lo in range(0, len(state), ROWS // 16):
                part = state[lo : lo + ROWS // 16]
                bufs = [pieces[k][at : at + room] for k, at in part]
                flat, off = self._rows(bufs, max(map(len, bufs)))
                for j, ((k, at), x) in enumerate(zip(part, bufs, strict=True)):
                    row = flat[off[j] : off[j + 1]]
                    if at + len(x) == len(pieces[k]):
                        done[k].append(row.tobytes())
                        continue
                    ends = np.cumsum([len(self.bytes_of[t]) for t in row.tolist()])
                    stable = max(1, int(np.searchsorted(ends, len(x) - self.lookahead, "right")))
                    done[k].append(row[:stable].tobytes())
                    later.append((k, at + int(ends[stable - 1])))
            state = later
        for k, x in done.items():
            out[k] = b"".join(x)
        return out

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces: each is cut into pre-tokens, and each distinct one goes through the transducer once."""
        cut, find = [], self.pre.findall
        fresh: dict[str, bytes] = {}
        for raw in pieces:
            p = raw.decode()
            if p.isalpha() or (p[0] == " " and p[1:].isalpha()):
                ts = (p,)
            elif p[-1] in ".," and len(p) > 2 and p[1:-1].isalpha() and (p[0] == " " or p[0].isalpha()):
                ts = (p[:-1], p[-1])
            else:
                ts = find(p)
            cut.append(ts)
            for t in ts:
                fresh[t] = b""
        fresh = dict(zip(fresh, self._streams([t.encode() for t in fresh]), strict=True))
        return [fresh[ts[0]] if len(ts) == 1 else b"".join([fresh[t] for t in ts]) for ts in cut]

    def encode_rows(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of each row's text, as 32-bit little-endian bytes."""
        raw = data.tobytes()
        starts, ends, row = pieces_of(data, offs)
        at, n = self.pieces.find(data, starts, ends)
        ids = self.pieces.ids(at, n).astype("<u4", copy=False).tobytes()
        cut = (np.concatenate([[0], np.cumsum(n)])[row] * 4).tolist()
        out = [ids[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        odd = [m.start() for m in _MIXED.finditer(raw)] + [m.start() for c in self.added for m in re.finditer(re.escape(c), raw)]
        for k in set((np.searchsorted(offs, odd, "right") - 1).tolist()):
            out[k] = self._alone(raw[offs[k] : offs[k + 1]])
        return out

    def _alone(self, text: bytes) -> bytes:
        """Ids of a text that holds added tokens' strings, or white space that pieces can't be cut at."""
        out = []
        for k, stretch in enumerate(self.split_added.split(text.decode()) if self.split_added else [text.decode()]):
            if k % 2:
                out.append(np.array([self.added[stretch.encode()]], "<u4").tobytes())
            elif stretch:
                ts = self.pre.findall(stretch)
                fresh = dict.fromkeys(ts)
                fresh = dict(zip(fresh, self._streams([t.encode() for t in fresh]), strict=True))
                out += [fresh[t] for t in ts]
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        return self.encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))

    # -- decoding

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete; an incomplete sequence becomes U+FFFD as the library has it."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.bytes_of[i]):
                yield text
        if text := machine.decode(b"", True):
            yield text

    def decode(self, ids: bytes, block: int = 1 << 16) -> str:
        """The text of 32-bit ids, a block of ids at a time through the state machine."""
        machine, of, out = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of.__getitem__, []
        flat = np.frombuffer(ids, "<u4")
        for at in range(0, len(flat), block):
            out.append(machine.decode(b"".join(map(of, flat[at : at + block].tolist()))))
        return "".join(out) + machine.decode(b"", True)


def sufficient_lookahead(left: list[int], right: list[int], made: list[int], length: dict[int, int], base: set[int]) -> int:
    """Bytes to the right of a token that can still change it.

    Two texts that differ only from some place on merge alike until a merge takes a token left of that place with one
    that begins there; the difference then moves left by that token. The next such merge ranks later, and its right
    part begins with the token just taken. So the longest reach is the longest chain of merges (a1,b1), (a2,b2), ...
    of rising rank where a1 begins b2, a2 begins b3, ...: found in one pass over the list.
    """
    seen, starts, reach, most = set(base), {}, {}, 0
    for a, b, c in zip(left, right, made, strict=True):
        if a not in seen or b not in seen:
            raise ValueError("a merge uses a token that no earlier merge makes")
        chain, x = 0, b
        while x is not None:
            chain = max(chain, reach.get(x, 0))
            x = starts.get(x)
        reach[a] = max(reach.get(a, 0), length[a] + chain)
        most = max(most, reach[a])
        starts.setdefault(c, a)
        seen.add(c)
    return most


_MADE: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One a worker process."""
    if path not in _MADE:
        _MADE[path] = Transducer(path)
    return _MADE[path]


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, names: list[str], schema: str, of) -> DataFrame:
    def run(batches):
        t = transducer(path)
        for b in batches:
            data, offs = text_bytes(b.column(1))
            for i, j in groups(offs, BATCH_BYTES):
                part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *of(t, t.encode_rows(part, at))], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ids (binary, 32-bit little-endian).

    A null text counts as empty (no ids); null ids and repeated rows stay; other columns are not read.
    """
    return _mapped(docs, tokenizer_path, id_col, text_col, ["ids"], "ids binary", lambda _, ids: [pa.array(ids, pa.binary())])


def decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ids as encode() gives them: doc_id and text. Null ids give a null text."""

    def run(batches):
        t = transducer(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and checksums of the ids and of the text decoded from them."""

    def of(t: Transducer, ids: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids]),
        ]

    return _mapped(docs, tokenizer_path, "doc_id", "text", ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string", of)
