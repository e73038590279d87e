"""The whole pipeline against plain loops over the smallest documents."""

import collections
import hashlib
import math
import re

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from tapeloom.llm import decontaminate, ordinal, vocab

SF = "/root/testdata/sf0.001"


def _graded(spark, docs):
    """Documents whose weights, summed one feature at a time, give the top grade."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = ordinal.train(frame, ordinal.graded(spark.read.parquet(f"{SF}/labels.parquet")))
    out = []
    for i, text in docs:
        data = np.frombuffer((text or "").encode(), np.uint8)
        feats, at = ordinal.features(data, np.array([0, len(data)]))
        total = sum(float(model.weights[f]) for f in feats[at[0] : at[1]].tolist())
        if 1 / (1 + math.exp(-min(max(total - float(model.cuts[-1]), -30), 30))) >= 0.5:
            out.append((i, text))
    return out


def _one_of_each(docs):
    sets = {}
    for i, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, t) for i, t in docs if find(i) == i]


def _without_passages(docs, length):
    raw, count = [(i, (t or "").encode()) for i, t in docs], collections.Counter()
    for _, t in raw:
        count.update(t[p : p + length] for p in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        left = "".join(t[m.start() : m.end()].decode(errors="ignore") for m in re.finditer(b"\0+", bytes(gone)))
        out.append((i, left))
    return out


def _without_leaks(spark, docs):
    def words(text):
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
        return np.array([int.from_bytes(hashlib.md5(re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)).digest()[:8], "big") for w in found], np.uint64)

    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(w := words(r["text"]))]
    assert min(map(len, items)) >= decontaminate.SEEDED_WORDS
    return [(i, t) for i, t in docs if not any(decontaminate.align(x, words(t))[0] >= len(x) for x in items)]


def test_pipeline_equals_plain_loops(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    sizes = [len(docs)]
    for stage in (lambda d: _graded(spark, d), _one_of_each, lambda d: _without_passages(d, corpus_pipeline.PASSAGE_BYTES), lambda d: _without_leaks(spark, d)):
        before, docs = docs, stage(docs)
        sizes.append(len(docs))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] and any(a != b for a, b in zip(before, docs, strict=False))
    tok = vocab.tokenizer(P.path(corpus_pipeline.TOKENIZER))
    want = []
    for i, text in docs:
        ids = tok.encode(text, add_special_tokens=False).ids
        said = tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == want
