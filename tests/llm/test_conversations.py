import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from tapeloom.llm import earley, packing, prefix_trie, repair, turns, vocab

SCHEMA = "conv_id long, turn long, role string, text string, cost int, gaps string, c int, key string"
TALK = "conv_id long, turn long, role string, text string"
BYTE = P.path("byte_bpe_50k.json")


def _cheapest(rows):
    """(cost, audit) from the end backwards; rows are (initial, doomed, extra)."""
    def step(state, initial):
        if state in ("", "end") and initial == "u" or state == "s" and initial == "u":
            return "u"
        if state == "u" and initial == "a":
            return "end"
        return "s" if state == "" and initial == "s" else None

    @cache
    def best(i, state, room):
        found = [(0, "")] if i == len(rows) and state in ("", "end") else []
        if i < len(rows):
            initial, doomed, extra = rows[i]
            c, a = best(i + 1, state, 3)
            found.append((c + 3, "D" + a))
            if not doomed:
                for edit, more, said in (("K", 0, initial), ("R", 2, "u"), ("R", 2, "a")):
                    if (to := step(state, said)) is not None:
                        c, a = best(i + 1, to, 3)
                        found.append((c + more + extra, edit + a))
        if room:
            for said in "ua":
                if (to := step(state, said)) is not None:
                    c, a = best(i, to, room - 1)
                    found.append((c + 2, "I" + a))
        return min(found, default=(10**9, ""))

    return best(0, "", 3)


@given(hs.lists(hs.tuples(hs.sampled_from(["u", "a", "s", "", "x"]), hs.booleans(), hs.integers(0, 1)), max_size=9))
@settings(max_examples=400, deadline=None)
def test_chart_finds_the_least_cost_and_audit(rows):
    chart = earley.Chart()
    for row in rows:
        chart.turn(*row)
    assert min(chart.ends(earley.ACCEPTED).values()) == _cheapest(tuple(rows))


def test_chart_of_long_conversations_by_blocks_and_bases():
    r = random.Random(4)
    for n in (63, 64, 65, 300):
        rows = [(r.choice("uuaas"), r.random() < 0.1, r.randrange(2)) for _ in range(n)]
        whole, blocks = earley.Chart(), []
        for k in range(0, n, 70):
            charts = {x: earley.Chart(x) for x in earley.SYMBOLS}
            for row in rows[k : k + 70]:
                for c in charts.values():
                    c.turn(*row)
            blocks.append({x: c.ends() for x, c in charts.items()})
        for row in rows:
            whole.turn(*row)
        want = _cheapest(tuple(rows))
        assert min(whole.ends(earley.ACCEPTED).values()) == want
        joined = earley.joined({earley.EMPTY: (0, "")}, blocks)
        assert min(joined[x] for x in earley.ACCEPTED if x in joined) == want


def _talk(seed, convs=40, most=9):
    r = random.Random(seed)
    said = ["Yes.", "No", "", "  ", "\t\n", "Well!", "So? ", "tail  \n", "été.", None]
    rows = []
    for c in range(convs):
        for t in range(r.randrange(0, most)):
            rows.append((c * 7 % 61, r.choice([t, t, t, t + 3, None]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), r.choice(said)))
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (5, 2, "user", "Yes."), (5, 2, "user", "Yes.")]
    return rows


def _key(x):
    return (x is not None, x or 0)


def _damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _reports(original, rows):
    by = defaultdict(list)
    for c, *rest in rows:
        by[c].append(tuple(rest))
    out = {}
    for c in {x[0] for x in original}:
        own = sorted(by[c], key=lambda x: (_key(x[0]), x[1].encode(), x[2].encode()))
        seen, marks, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = _cheapest(tuple(marks))
        ts = [t for t, _, _ in own if t is not None]
        lines, at, due = [], 0, 0
        for e in audit:
            if e != "I":
                role, text = own[at][1:]
                at += 1
            if e == "D":
                continue
            if e == "K" and role[:1] == "s":
                lines.append(f"{role}:{text}")
                continue
            said = ("user", "assistant")[due % 2]
            lines.append({"K": f"{role}:{text}", "R": f"{said}:{text}", "I": f"{said}:"}[e] if e != "I" else f"{said}:")
            due += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("giant", [repair.GIANT, 500])
def test_repair_equals_brute_force(spark, giant):
    rows = _talk(3)
    df = spark.createDataFrame([(*x, 1, "g", 2, "k") for x in rows], SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repair.report(repair.damage(df), giant).collect()}
    assert got == _reports(rows, _damaged(rows))
    assert any(x[6] for x in got.values())


def test_repaired_turns_make_the_hash(spark):
    df = spark.createDataFrame(_talk(8), TALK)
    for giant in (repair.GIANT, 300):
        want = {r["conv_id"]: r["repaired_sha256"] for r in repair.report(df, giant).collect()}
        by = defaultdict(list)
        for r in sorted(repair.repaired(df, giant).collect(), key=lambda r: r["place"]):
            by[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(by[c]).encode()).hexdigest() for c in want} == want


def test_long_conversation_in_blocks(spark):
    r = random.Random(6)
    rows = [(1, k, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Yes.", "No", f"w{k}.", f"v{k}"])) for k in range(700)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, TALK).repartition(5)
    assert {x[0]: tuple(x)[1:] for x in repair.report(df, 1000).collect()} == _reports(rows, rows)


def test_nothing_left_and_nothing_at_all(spark):
    empty = hashlib.sha256(b"").hexdigest()
    gone = spark.createDataFrame([(4, None, None, None, True)], TALK + ", gone boolean")
    assert [tuple(r) for r in repair.report(gone).collect()] == [(4, 0, 0, 0, 0, 0, 0, "", empty)]
    none = spark.createDataFrame([], TALK)
    assert not repair.report(repair.damage(none)).count() and not repair.repaired(none).count() and not prefix_trie.shared(none).count()


# -- prefix trie


def _trie(rows, block=20, kinds=4):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((_key(t), (role or "").encode(), (text or "").encode()))
    by = {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % kinds
        path = tuple(by.get(c - c % block, [])[:h] + own[h:])
        ends[path].add(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    out = []
    for path, who in members.items():
        under = [p for p in members if p[: len(path)] == path]
        leaves = sum(not kids[p] for p in under)
        saved = sum((len(members[p]) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        up = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), up, len(who), kids[path], leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()))
    return sorted(out, key=str)


def _shared_talk(seed):
    """Long copies, shared beginnings of every length, lone conversations."""
    r = random.Random(seed)
    rows, talk = [], [("user" if k % 2 == 0 else "assistant", f"turn {k} " + "word " * (k % 5)) for k in range(9)]
    for c in range(150):
        n = r.randrange(1, 10) if c % 3 else 9
        own = talk[:n] + [("user", f"own {c}")] * (c % 4 == 1) + [("user", r.choice(["x", "y z"]))] * (c % 5 == 2)
        rows += [(c * 20 if c < 60 else c, k, role, text) for k, (role, text) in enumerate(own)]
    return rows + [(None, 0, "user", "x"), (7001, None, None, None), (7001, None, "a", None), (7002, 1, "", ""), (7002, 1, "", "")]


@pytest.mark.parametrize("limit", [prefix_trie.LIMIT, 5])
def test_trie_equals_brute_force(spark, limit):
    rows = _shared_talk(2) + _talk(5)
    df = spark.createDataFrame([(*x, 1, "g", 2, "k") for x in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, prefix_trie.shared(df, limit=limit).collect()), key=str) == _trie(rows)


def test_many_copies_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    rows = [(c, 0, "user", "same words") for c in range(0, 400 * 20, 20)]
    got = {r["depth"]: r for r in prefix_trie.shared(spark.createDataFrame(rows, TALK)).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(str(c) for c, *_ in rows).encode()).hexdigest()
    assert (got[0]["n_convs"], got[1]["saved_tokens"], got[0]["n_leaves"]) == (400, 399 * 2, 1)


def test_turn_digests_tell_role_and_text_apart(spark):
    df = spark.createDataFrame([(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "a", ":bc"), (4, 0, "a:", "bc")], TALK)
    assert turns.ordered(df).select("turn_digest").distinct().count() == 4


# -- packing


@given(hs.lists(hs.integers(1, 100), min_size=1, max_size=60), hs.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_differencing_keeps_every_part_and_evens_out(sizes, k):
    found = packing.differencing(sizes, k)
    assert len(found) == k and sorted(i for w in found for i in w) == list(range(len(sizes)))
    loads = [sum(sizes[i] for i in w) for w in found]
    assert max(loads) - min(loads) <= max(sizes)


def _padding(length, cap):
    return 0 if length & (length - 1) == 0 else cap - length


@given(hs.lists(hs.integers(0, 63), max_size=80))
@settings(max_examples=80, deadline=None)
def test_windows_hold_every_part_once(sizes):
    found = packing.balance(sizes, 64, 1 / 8)
    spans = defaultdict(list)
    for w in found:
        length = sum(n for _, _, n in w)
        assert 0 < length <= 64 and _padding(length, 64) <= 8
        for i, start, n in w:
            spans[i].append((start, n))
    for i, size in enumerate(sizes):
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at and n > 0
            at += n
        assert at == size


@pytest.mark.parametrize(("cap", "windows"), [(1024, 256), (64, 3), (1, 1)])
def test_pieces_cover_the_ids_of_the_library(spark, odd, cap, windows):
    rows = odd.select("doc_id", "text").collect()
    tok = vocab.tokenizer(BYTE)
    want = sorted((str(r["doc_id"]), tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in rows)
    pieces = packing.pack(odd, BYTE, 0, cap, windows=windows).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = tuple(int.from_bytes(p["ids"][k : k + 4], "little") for k in range(0, len(p["ids"]), 4))
        assert len(ids) == p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        docs[str(p["doc_id"])].append((p["start"], p["doc_tokens"], ids))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= cap and _padding(at, cap) <= cap * packing.SLACK
    by = defaultdict(list)
    for doc, ids in want:
        by[doc].append(ids)
    for doc, many in by.items():
        total = sum(map(len, many))
        assert sum(len(ids) for _, _, ids in docs[doc]) == total
        if len(many) == 1:
            parts = sorted(docs[doc])
            assert tuple(x for _, _, ids in parts for x in ids) == many[0] and {n for _, n, _ in parts} == {total}
            assert [s for s, _, _ in parts] == [sum(len(i) for _, _, i in parts[:k]) for k in range(len(parts))]


def test_nothing_to_pack(none):
    assert not packing.pack(none, BYTE).count()
