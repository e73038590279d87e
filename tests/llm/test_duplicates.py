import collections
import hashlib
import random

import numpy as np
import pytest

from tapeloom.llm import components, jaccard, polytope, repeats, scratch


def _roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    r = random.Random(3)
    links = {"path": [(k, k + 1) for k in range(300)], "star": [(0, k) for k in range(1, 200)], "random": [(r.randrange(400), r.randrange(400)) for _ in range(300)]}[shape]
    got = components.components(spark.createDataFrame(links, "u long, v long").repartition(7), scratch.Work()).collect()
    want = _roots({x for e in links for x in e}, links)
    want = {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in links)}
    assert {x["node"]: x["component_id"] for x in got} == want and len(got) == len(want)


def _set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            k = len(a & b)
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * k >= 80 * (len(a) + len(b) - k):
                links.append((rows[i][0], rows[j][0]))
    root = _roots({i for i, _ in rows if i is not None}, links)
    return sorted(((i, len(s), root.get(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


CONTRACT = ("doc_id", "n_shingles", "component_id")


def _near(seed, groups=12, copies=14):
    """Groups of edited copies, sharing passages across groups, and chains whose ends are far apart."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    passages = [" ".join(r.choice(vocab) for _ in range(40)) for _ in range(5)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(20, 300))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.2:
                base = w
            out.append(" ".join(w) + (" " + r.choice(passages) if r.random() < 0.3 else ""))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_join_is_exact(spark, monkeypatch, seed):
    """The second time with more buckets than tasks."""
    if seed:
        monkeypatch.setattr(scratch, "BUCKET_BYTES", 5000)
    rows = _near(seed)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.select(*CONTRACT).collect()), key=str) == _brute(rows)


def test_jaccard_join_opens_clusters_of_subsets(spark):
    """Truncations and extensions: a member that is a part of its leader links where the leader cannot."""
    r, rows = random.Random(4), []
    for k in range(150):
        w = [f"g{k}w{x}" for x in range(170)]
        lo = r.randrange(3)
        nested = [w[: 104 + 60 * (lo == 0)], w[: 86 + 48 * (lo == 0)], w[: 72 + 36 * (lo == 0)]] if lo < 2 else [w[:104], w[:86], [*w[2:74], "x"]]
        r.shuffle(nested)
        rows += [" ".join(x) for x in nested]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.select(*CONTRACT).collect()), key=str) == _brute(rows)


def test_jaccard_pairs_of_one_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies of one text with two edits each, of which about half of the pairs link: the rows that are compared stay few a copy."""
    r = random.Random(9)
    base, made = [f"b{k}" for k in range(150)], []
    for k in range(300):
        w, at = list(base), r.randrange(5, 135)
        w[at], w[at + r.randint(1, 5)] = f"x{k}", f"y{k}"
        made.append(" ".join(w))
    rows, counts = list(enumerate(made)), []
    table = scratch.Work.table

    def counted(self, df, name):
        out = table(self, df, name)
        if name in ("bounds", "cluster-pairs"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(scratch.Work, "table", counted)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(12))
    assert sorted(map(tuple, got.select(*CONTRACT).collect()), key=str) == _brute(rows)
    assert sum(counts) < 40 * len(rows)


def test_jaccard_odd_rows(odd, none):
    rows = [tuple(x) for x in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.join(odd).select(*CONTRACT).collect()), key=str) == _brute(rows)
    assert jaccard.join(none).count() == 0


def test_sketch_never_bounds_below_the_overlap():
    r = np.random.default_rng(5)
    for n in (3, 50, 700, 4000):
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        a, b = x[: 2 * n // 3 + 1], x[n // 3 :]
        for c in (b, x[:5]):
            assert (len(a) + len(c) - jaccard.apart(jaccard.parity_bits(a), jaccard.parity_bits(c))) // 2 >= len(np.intersect1d(a, c))


def _removed(texts, length):
    ts, count = [(t or "").encode() for t in texts], collections.Counter()
    for t in ts:
        count.update(t[p : p + length] for p in range(len(t) - length + 1))
    out = []
    for t in ts:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def _passages(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    para = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [para(r.randint(20, 120)) for _ in range(8)]
    texts = ["\n".join(r.choice(shared) if r.random() < 0.4 else para(r.randint(5, 60)) for _ in range(r.randint(1, 5))) for _ in range(60)]
    return [*texts, texts[3], texts[3], None, "", "x" * 1500, "ab" * 500, "x" * 399, "y" * 400, "y" * 400, texts[7][:450], texts[7][1:500]]


@pytest.mark.parametrize(("length", "small"), [(400, False), (120, False), (120, True)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, small):
    """Also with more buckets than tasks, and with groups larger than a block."""
    if small:
        monkeypatch.setattr(scratch, "BUCKET_BYTES", 3000)
        monkeypatch.setattr(repeats, "BLOCK", 7)
        monkeypatch.setattr(repeats, "HELD", 50)
    texts = _passages(length)
    got = repeats.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), length).collect()
    assert {x["doc_id"]: tuple(x)[1:5] for x in got} == dict(enumerate(_removed(texts, length)))


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    texts = _passages(9)[:20]
    whole = "\n".join(t for t in texts if t)
    data = np.frombuffer((whole * 2).encode(), np.uint8)
    one = repeats.marks(data, np.array([0, len(data)]), 400)
    monkeypatch.setattr(repeats, "STRETCH", 1000)
    windows = []
    for part, at, _, before in repeats._stretches(data, np.array([0, len(data)]), 400):
        h, place, lo, hi = repeats.marks(part, at, 400)
        for k in range(len(h)):
            windows += [(p + before, place[k] + before) for p in range(lo[k], hi[k] + 1)]
    assert sorted(windows) == sorted((p, one[1][k]) for k in range(len(one[0])) for p in range(one[2][k], one[3][k] + 1))


def test_repeats_odd_rows(odd, none):
    rows = odd.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(rows, _removed([r["text"] for r in rows], 400), strict=True)), key=str)
    got = repeats.remove(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert repeats.remove(none).count() == 0
    kept = repeats.remove(odd, extra=["key", "size"])
    assert kept.columns == ["doc_id", "text", "key", "size"] and kept.count() == len(rows)


def _vectors(seed):
    r = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = r.normal(size=64)
            for _ in range(6):
                v = base + r.normal(size=64) * r.choice([0, 0.02, 0.2, 0.3])
                rows.append((k, [float(x) for x in v * r.choice([1.0, 2.0])], label))
                k += 1
    odd = [None, [], [0.0] * 64, [1.0, None, 3.0], [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], rows[0][1], rows[0][1]]
    return rows + [(k + i, v, 0) for i, v in enumerate(odd)]


def _cosines(rows):
    ok = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    return [(rows[i][0], rows[j][0]) for i in ok for j in ok if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]


@pytest.mark.parametrize("chunk", [2048, 3])
def test_vectors_link_as_their_cosines_do(spark, monkeypatch, chunk):
    monkeypatch.setattr(polytope, "CHUNK", chunk)
    rows = _vectors(1)
    links = _cosines(rows)
    n = collections.Counter(x for e in links for x in e)
    got = {x["vec_id"]: x for x in polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    found = sum(x["n_links"] for x in got.values())
    assert len(got) == len(rows) and all(got[k]["n_links"] <= n[k] for k in got)
    assert found >= 0.9 * 2 * len(links)
    if found == 2 * len(links):
        assert {k: x["component_id"] for k, x in got.items()} == _roots(set(got), links)
    assert all(x["kept"] == (x["component_id"] == k) for k, x in got.items())


@pytest.mark.parametrize("dim", [48, 384])
def test_recall_at_the_threshold(spark, dim):
    """Pairs just above the threshold, the hardest to find: at least nine in ten have to be found."""
    r, rows = np.random.default_rng(dim), []
    for k in range(250):
        a, b = r.normal(size=dim), r.normal(size=dim)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = r.uniform(0.93, 0.95)
        rows += [(2 * k, a.tolist(), k % 3), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), k % 3)]
    got = polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    links = _cosines(rows)
    assert len(links) >= 240 and sum(x["n_links"] for x in got) >= 0.9 * 2 * len(links)
    assert sum(x["n_links"] for x in got) <= 2 * len(links)


def test_vectors_without_or_with_repeated_ids(spark):
    """Null ids link with nothing; rows of one id each count; other columns, whatever their names, are not read."""
    v, w = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.01]
    rows = [(None, v, 1, "x", 7), (5, v, 1, None, 7), (5, v, 1, "x", None), (7, w, 1, "k", 1), (8, v, None, "k", 1), (9, v, 2, "k", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string, n_links int")
    got = sorted(map(tuple, polytope.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 0, None, None), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 0, 8, True), (9, 0, 9, True)], key=str)


def test_no_vectors(spark):
    assert polytope.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, key string")).count() == 0
