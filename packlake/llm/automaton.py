"""One deterministic automaton out of several grammars.

Grammars are regular expressions of signs, classes ``[a-z]`` and ``[^a-z]``, groups ``( | )`` and the repetitions ``* + ? {m} {m,} {m,n}``.
All of them are put together as one nondeterministic automaton, whose sets of states become the states of the deterministic one.
A run reads each sign once and tells the longest match and the grammar it belongs to, the first of several.
"""

from __future__ import annotations

#: Signs beyond ASCII are one class; negated classes hold it.
OTHER = 128
_ALL = (1 << (OTHER + 1)) - 1


def any_case(word: str) -> str:
    """The expression of a word in small and capital letters."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


class Automaton:
    """The union of named grammars, matched from a given place."""

    def __init__(self, grammars: dict[str, str]):
        self.names = list(grammars)
        self._steps: list[list[tuple[int, int]]] = []  # per state: (mask of signs, next state); mask 0 takes no sign
        start, ends = self._state(), {}
        for number, grammar in enumerate(grammars.values()):
            first, last = self._read(grammar)
            self._steps[start].append((0, first))
            ends[last] = number
        self._determine(start, ends)
        del self._steps

    def match(self, text: str, at: int = 0) -> tuple[str, int] | None:
        """The grammar and the end of the longest match that begins at ``at``."""
        table, accepts, state, best = self.table, self.accepts, 0, None
        for place in range(at, len(text)):
            sign = ord(text[place])
            state = table[state][sign if sign < OTHER else OTHER]
            if state < 0:
                break
            if accepts[state] >= 0:
                best = (self.names[accepts[state]], place + 1)
        return best

    # ---- building

    def _state(self) -> int:
        self._steps.append([])
        return len(self._steps) - 1

    def _read(self, grammar: str) -> tuple[int, int]:
        place = 0

        def alternatives() -> tuple[int, int]:
            nonlocal place
            first, last = self._state(), self._state()
            while True:
                a, b = sequence()
                self._steps[first].append((0, a))
                self._steps[b].append((0, last))
                if place >= len(grammar) or grammar[place] != "|":
                    return first, last
                place += 1

        def sequence() -> tuple[int, int]:
            nonlocal place
            first = last = self._state()
            while place < len(grammar) and grammar[place] not in "|)":
                begin = place
                unit()
                after = place
                least, most = repetition()
                end = place
                for n in range(max(least, most or 0) if most is not None else least + 1):
                    place = begin
                    a, b = unit()
                    self._steps[last].append((0, a))
                    if most is None and n == least:  # the last copy may be left out and may come again
                        out = self._state()
                        self._steps[last].append((0, out))
                        self._steps[b] += [(0, a), (0, out)]
                        last = out
                    elif n >= least:
                        out = self._state()
                        self._steps[last].append((0, out))
                        self._steps[b].append((0, out))
                        last = out
                    else:
                        last = b
                place = max(end, after)
            return first, last

        def repetition() -> tuple[int, int | None]:
            nonlocal place
            sign = grammar[place : place + 1]
            if sign and sign in "*+?":
                place += 1
                return {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
            if sign == "{":
                close = grammar.index("}", place)
                least, comma, most = grammar[place + 1 : close].partition(",")
                place = close + 1
                return int(least), (int(most) if most else None) if comma else int(least)
            return 1, 1

        def unit() -> tuple[int, int]:
            nonlocal place
            sign = grammar[place]
            place += 1
            if sign == "(":
                inner = alternatives()
                place += 1
                return inner
            if sign == "[":
                close = grammar.index("]", place + 1)
                mask, place = self._class(grammar[place:close]), close + 1
            else:
                if sign == "\\":
                    sign, place = grammar[place], place + 1
                mask = 1 << ord(sign)
            first, last = self._state(), self._state()
            self._steps[first].append((mask, last))
            return first, last

        return alternatives()

    @staticmethod
    def _class(body: str) -> int:
        negated = body.startswith("^")
        signs, mask, at = body[1:] if negated else body, 0, 0
        for escape, sign in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\f", "\f")):
            signs = signs.replace(escape, sign)
        while at < len(signs):
            if signs[at + 1 : at + 2] == "-" and at + 2 < len(signs):
                for code in range(ord(signs[at]), ord(signs[at + 2]) + 1):
                    mask |= 1 << code
                at += 3
            else:
                mask |= 1 << ord(signs[at])
                at += 1
        return _ALL & ~mask if negated else mask

    def _closed(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for mask, after in self._steps[todo.pop()]:
                if not mask and after not in found:
                    found.add(after)
                    todo.append(after)
        return frozenset(found)

    def _determine(self, start: int, ends: dict[int, int]) -> None:
        masks = {mask for steps in self._steps for mask, _ in steps if mask}
        told = [tuple(mask >> sign & 1 for mask in masks) for sign in range(OTHER + 1)]
        number_of = {kind: n for n, kind in enumerate(dict.fromkeys(told))}  # signs that no class tells apart are one kind
        kind_of = [number_of[kind] for kind in told]
        kinds_in = {mask: {kind_of[sign] for sign in range(OTHER + 1) if mask >> sign & 1} for mask in masks}
        first = self._closed({start})
        known, todo = {first: 0}, [first]
        closures: dict[frozenset[int], frozenset[int]] = {}
        self.table: list[list[int]] = []
        self.accepts: list[int] = []
        for states in todo:  # grows as states are met
            self.accepts.append(min((ends[s] for s in states if s in ends), default=-1))
            reached: dict[int, set[int]] = {}
            for s in states:
                for mask, after in self._steps[s]:
                    for kind in kinds_in.get(mask, ()):
                        reached.setdefault(kind, set()).add(after)
            row = [-1] * len(number_of)
            for kind, after in reached.items():
                key = frozenset(after)
                closed = closures.get(key)
                if closed is None:
                    closed = closures[key] = self._closed(after)
                    if closed not in known:
                        known[closed] = len(todo)
                        todo.append(closed)
                row[kind] = known[closed]
            self.table.append([row[kind] for kind in kind_of])
