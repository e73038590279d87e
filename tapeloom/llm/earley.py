"""An error-correcting Earley chart for the roles of a conversation.

The grammar says which role initials may follow each other: nothing at all, or pairs of user and assistant after at
most one system turn. Every production is left-recursive, so all items begin at the chart's first set and a set holds,
for each symbol X, only the items [Y -> X . t] that X's completion opens. Errors are productions too: a turn of another
role stands for t at a cost, t may be missing at a cost, and X -> X turn deletes. An item keeps the least (cost, audit):
the edits' initials so far. Audits grow with the conversation; sets hold them as a base that several items share and a
short tail, and every RENEW turns tails become bases, ranked as their texts are, so a step costs the same at any length.
"""

from __future__ import annotations

#: Symbols: nothing yet, system read, user read (its answer is due), pairs complete.
EMPTY, SYSTEM, USER, PAIR = range(4)
SYMBOLS = (EMPTY, SYSTEM, USER, PAIR)
#: Productions by the symbol they begin with: the terminal that follows, and the symbol made.
OPENS = {EMPTY: (("s", SYSTEM), ("u", USER)), SYSTEM: (("u", USER),), USER: (("a", PAIR),), PAIR: (("u", USER),)}
ACCEPTED = (EMPTY, PAIR)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
RENEW = 64

Item = tuple[int, int, str]  # cost, rank of the audit's base, rest of the audit


class Chart:
    """The newest set of the chart, begun with one symbol complete."""

    def __init__(self, begin: int = EMPTY):
        self.parents: list[int] = [-1]
        self.texts: list[str] = [""]
        self.bases = [0]
        self.read = 0
        self.items: dict[int, Item] = {begin: (0, 0, "")}
        self._insert()

    def _insert(self) -> None:
        """Complete symbols over turns that are missing; two in a row give each symbol its pair's other half."""
        items = self.items
        for _ in range(2):
            for x in tuple(items):
                cost, base, tail = items[x]
                made = USER if x != USER else PAIR
                new = (cost + INSERT, base, tail + "I")
                if made not in items or new < items[made]:
                    items[made] = new

    def turn(self, initial: str, doomed: bool, extra: int) -> None:
        """Read one turn; doomed ones can only be deleted, extra is what a turn costs that stays."""
        new: dict[int, Item] = {}
        for x, (cost, base, tail) in self.items.items():
            item = (cost + DELETE, base, tail + "D")
            if x not in new or item < new[x]:
                new[x] = item
            if doomed:
                continue
            for t, made in OPENS[x]:
                if t == initial:
                    item = (cost + extra, base, tail + "K")
                elif t != "s":
                    item = (cost + REROLE + extra, base, tail + "R")
                else:
                    continue
                if made not in new or item < new[made]:
                    new[made] = item
        self.items = new
        self._insert()
        self.read += 1
        if not self.read % RENEW:
            self._renew()

    def _renew(self) -> None:
        """Tails become bases. One that goes on from another's text shares its base and keeps what follows as tail."""
        bases, last = [], None
        for base, tail, cost, x in sorted((b, t, c, x) for x, (c, b, t) in self.items.items()):
            if last is None or last[0] != base or not tail.startswith(last[1]):
                last = (base, tail)
                self.parents.append(self.bases[base])
                self.texts.append(tail)
                bases.append(len(self.texts) - 1)
            self.items[x] = (cost, len(bases) - 1, tail[len(last[1]) :])
        self.bases = bases

    def audit(self, x: int) -> str:
        _, base, tail = self.items[x]
        out, at = [tail], self.bases[base]
        while at >= 0:
            out.append(self.texts[at])
            at = self.parents[at]
        return "".join(reversed(out))

    def ends(self, over: tuple[int, ...] = SYMBOLS) -> dict[int, tuple[int, str]]:
        """Least (cost, audit) by symbol."""
        return {x: (self.items[x][0], self.audit(x)) for x in over if x in self.items}


def initial(role: str) -> str:
    return role[:1]


def applied(audit: str, rows):
    """(edit, role, text) of each turn that the edits leave; rows are (role, text) in order."""
    rows, due = iter(rows), "u"
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "K" and initial(role) == "s":
            yield edit, role, text
            continue
        yield edit, role if edit == "K" else ROLES[due], text
        due = "a" if due == "u" else "u"


def joined(first: dict[int, tuple[int, str]], blocks: list[dict[int, dict[int, tuple[int, str]]]]) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) by symbol after blocks that were each read from every symbol they can begin with."""
    now = first
    for block in blocks:
        new: dict[int, tuple[int, str]] = {}
        for x, (cost, audit) in now.items():
            for made, (more, rest) in block[x].items():
                if made not in new or cost + more < new[made][0] or cost + more == new[made][0] and audit + rest < new[made][1]:
                    new[made] = (cost + more, audit + rest)
        now = new
    return now
