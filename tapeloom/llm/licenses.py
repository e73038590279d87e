"""Licence scans by ordered signature rules.

Rules are hand-written regexes over the ASCII-lower-cased text (license_rules). One pass of an automaton finds which
keywords a text has, and only their rules are tried; overlapping detections are resolved by priority and interval
containment. Four base phrases are always counted.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import groupby
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.bytesets import LOWER, groups, spans, text_bytes
from tapeloom.llm.license_rules import SIGNATURES

# The phrases that count as base places, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Priority and score of a kind of signature; an identifier after its tag counts as one.
KINDS = {"tag": (100, 1.0), "text": (90, 0.95), "notice": (80, 0.9), "url": (70, 0.9), "id": (60, 0.85), "named": (50, 0.8), "name": (20, 0.5)}
TAG = r"spdx-license-identifier:\s*\(?"
BLANK = r"\s\-*#/>"
VERSION = r"(?P<v>[0-9](?:\.[0-9]{1,2}){0,2})"
_SEP, _WORD = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", rb"[0-9a-z\x80-\xff]"
WORDS = np.zeros(256, bool)
WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Rule(NamedTuple):
    label: str
    version: str
    keyword: str
    priority: int
    score: float
    pattern: re.Pattern


def _spaced(regex: str) -> str:
    """Blanks of a signature as the bytes that may stand for them."""
    return re.sub(r"\[[^\]]*\]| \??", lambda m: m[0].replace(" ", BLANK) if m[0][0] == "[" else f"[{BLANK}]{'*' if m[0] == ' ?' else '+'}", regex)


@cache
def rules() -> list[Rule]:
    """All rules, strongest first."""
    found = []
    for line in SIGNATURES.strip().splitlines():
        label, version, kind, keyword, regex = (x.strip() for x in line.split("|", 4))
        body = _spaced(regex.replace("{v}", r"(?:version |v\.? ?)?{n}")).replace("{n}", VERSION)
        if kind in ("tag", "id"):
            body = f"(?P<tag>{TAG}){'?' if kind == 'id' else ''}(?:{body})"
        pattern = re.compile(rb"(?<!" + _WORD + rb")(?:" + body.encode() + rb")(?!" + _WORD + rb"|\.[0-9])")
        plain = re.sub(r"[^0-9a-z]+", " ", keyword)
        found.append(Rule(label, "" if "{" in version else version, f" {plain}", *KINDS[kind], pattern))
    return sorted(found, key=lambda r: (-r.priority, r.label, r.version))


@cache
def _keywords():
    """Automaton of the keywords; each leads to the rules (or, below zero, the base phrases) that need it."""
    needed: dict[str, list[int]] = {}
    for k, r in enumerate(rules()):
        needed.setdefault(r.keyword, []).append(k)
    for k, phrase in enumerate(BASE_PHRASES):
        needed.setdefault(f" {phrase}", []).append(-1 - k)
    a = ahocorasick.Automaton()
    for word, of in needed.items():
        a.add_word(word, tuple(of))
    a.make_automaton()
    return a


@cache
def _base() -> list[tuple[str, re.Pattern]]:
    return [(label, re.compile(rb"(?<!" + _WORD + rb")" + _SEP.join(w.encode() for w in phrase.split()) + rb"(?!" + _WORD + rb")")) for phrase, label in BASE_PHRASES.items()]


def _plain(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray]:
    """The words with one blank before each, and where each ends in that."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    at = np.arange(size.sum()) - np.repeat(stop - size, size) - 1
    out = low[np.repeat(starts, size) + np.maximum(at, 0)]
    out[stop - size] = 0x20
    return out.tobytes().decode("latin-1"), stop


def candidates(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> dict[int, set[int]]:
    """Rules and base phrases whose keyword stands in a row; words are starts..ends, row their offsets by row."""
    text, stop = _plain(low, starts, ends)
    found: dict[int, set[int]] = {}
    for end, of in _keywords().iter(text):
        word = int(np.searchsorted(stop, end, "right"))
        k = int(np.searchsorted(row, word, "right")) - 1
        found.setdefault(k, set()).update(of)
    return found


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    version: str
    priority: int
    score: float


def _words(low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(low, np.uint8)
    return data, *spans(data, np.array([0, len(data)]), WORDS)


def _apart(found: list[Detection]) -> list[Detection]:
    """Detections that no stronger one overlaps and none of their strength contains, by sweeps over sorted intervals."""
    kept: list[Detection] = []
    taken = np.zeros((0, 2), np.int64)  # disjoint, ascending: what stronger ones cover
    for _, same in groupby(sorted(found, key=lambda d: (-d.priority, d.start, -d.end, -len(d.label), d.label)), key=lambda d: d.priority):
        own, reach = [], -1
        for d in same:
            k = int(np.searchsorted(taken[:, 1], d.start, "right"))
            if k < len(taken) and taken[k, 0] < d.end:
                continue
            if d.end > reach:
                own.append(d)
                reach = d.end
        kept += own
        x = np.concatenate([taken, np.array([(d.start, d.end) for d in own], np.int64).reshape(-1, 2)])
        x = x[np.argsort(x[:, 0], kind="stable")]
        if len(x):
            end = np.maximum.accumulate(x[:, 1])
            first = np.flatnonzero(np.append(True, x[1:, 0] > end[:-1]))
            taken = np.stack([x[first, 0], end[np.append(first[1:], len(x)) - 1]], 1)
    return sorted(kept)


def detect(low: bytes, tried: set[int] | None = None) -> list[Detection]:
    """Detections in a lower-cased text: of two that overlap the one of higher priority stands, of one kind the containing one.

    tried are the rules whose keyword the text has; they are looked up where not given.
    """
    if tried is None:
        tried = candidates(*_words(low)).get(0, set())
    raw = []
    for k in tried:
        if k < 0:
            continue
        r = rules()[k]
        for m in r.pattern.finditer(low):
            got = m.groupdict()
            version = got["v"].decode() if got.get("v") else r.version
            strength = KINDS["tag"] if got.get("tag") else (r.priority, r.score)
            raw.append(Detection(m.start(), m.end(), r.label, version.removesuffix(".0") if r.label.endswith("gpl") else version, *strength))
    return _apart(raw)


def base_places(low: bytes, tried: set[int] | None = None) -> list[tuple[int, str]]:
    """Byte offset and label of each place of a base phrase."""
    return [(m.start(), label) for k, (label, p) in enumerate(_base()) if tried is None or -1 - k in tried for m in p.finditer(low)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, word and base counts, labels, score, and the detections' spans (bytes).

    A null text counts as empty: no words, no labels (empty strings), score 0. Null ids and repeated rows stay; other
    columns are not read. Of equal detections the one first in the text stands.
    """

    def run(batches):
        for b in batches:
            data, offs = text_bytes(b.column(1))
            for i, j in groups(offs):
                low, at = LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
                starts, ends, row = spans(low, at, WORDS)
                raw, hits = low.tobytes(), candidates(low, starts, ends, row)
                cols = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
                for k in range(j - i):
                    places, found = [], []
                    if k in hits:
                        text = raw[at[k] : at[k + 1]]
                        places, found = base_places(text, hits[k]), detect(text, hits[k])
                    where = (np.searchsorted(starts, at[k] + np.array([p for p, _ in places], np.int64)) - row[k]).tolist()
                    own = {x for _, x in places}
                    cols["n_base"].append(len(places))
                    cols["first_word"].append(min(where, default=None))
                    cols["last_word"].append(max(where, default=None))
                    cols["base_labels"].append(",".join(sorted(own)))
                    cols["labels"].append(",".join(sorted(own | {d.label for d in found})))
                    cols["score"].append(max([0.5 * bool(own), *(d.score for d in found)]))
                    cols["detections"].append([{"start": d.start, "end": d.end, "label": d.label, "version": d.version} for d in found])
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("version", pa.string())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(row), pa.int64()), *(pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True))],
                    names=["doc_id", "n_words", *cols],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:bigint,end:bigint,label:string,version:string>>")
