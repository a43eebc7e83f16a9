"""Parsing with derivatives: languages as expressions, recognised by taking memoised derivatives over token streams.

The derivative of a language by a token is what may follow that token. Expressions are made once each (equal ones are the same
object), every one remembers its derivatives by token and by word of tokens, so a stream over familiar ground costs a lookup per line.
An empty derivative marks the token at fault; a last derivative without the empty word means the text broke off.

A language is kept as alternatives of a first item and what follows it, one alternative per first item: sequences are drawn out of
alternatives and equal first items share what follows. What is still open in a text (brackets, blocks) so lies behind the first items as a
shared chain, and a derivative touches the front of it alone, however deep the text nests.

Grammars may be ambiguous but must not be left-recursive; repetition is written ``{ }``.
"""

from __future__ import annotations

import re


class Node(dict):
    """A language; the dictionary holds its derivatives by token."""

    __slots__ = ("nullable", "parts", "table", "words")

    def __init__(self, table: Grammar, parts: tuple, nullable: bool):
        super().__init__()
        self.table, self.parts, self.nullable = table, parts, nullable
        self.words: dict[str, Node] = {}

    __hash__ = object.__hash__

    def __eq__(self, other: object) -> bool:
        return self is other

    def __missing__(self, token: str) -> Node:
        return derive(self, token)


def derive(node: Node, token: str) -> Node:
    """The derivative of a language by a token that it does not remember yet; calls itself in Python alone, so the recursion limit is the only limit."""
    kind, table, parts = node.parts[0], node.table, node.parts
    if kind == "set":
        out = table.eps if token in parts[1] else table.empty
    elif kind == "cat":
        head, tail = parts[1], parts[2]
        out = table.cat(head.get(token) or derive(head, token), tail)
        if head.nullable:
            out = table.alt((out, tail.get(token) or derive(tail, token)))
    elif kind == "alt":
        out = table.alt([x.get(token) or derive(x, token) for x in parts[1]])
    elif kind == "star":
        out = table.cat(parts[1].get(token) or derive(parts[1], token), node)
    elif kind == "ref":
        body = table.bodies[parts[1]]
        out = body.get(token) or derive(body, token)
    else:
        out = table.empty
    node[token] = out
    table.made += 1
    return out


class Grammar:
    """A grammar with its expressions; rules are lines ``name = items``, alternatives by ``|``, ``( )`` groups, ``[ ]`` may miss, ``{ }`` repeats.

    A quoted item is one token, a name in capitals a set of tokens, any other name a rule. Tokens are single characters.
    """

    _ITEM = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_]\w*)|([|()\[\]{}=]))")

    def __init__(self, rules: str, tokens: dict[str, str], sets: dict[str, str], start: str = "start", limit: int = 200_000):
        self.rules, self.tokens, self.sets, self.start_rule, self.limit = rules, tokens, sets, start, limit
        self.reset()

    def reset(self) -> None:
        """Forget all derivatives; between texts, when they have become too many."""
        self.made = 0
        self.known: dict[tuple, Node] = {}
        self.empty = Node(self, ("empty",), False)
        self.eps = Node(self, ("eps",), True)
        self.bodies: dict[str, Node] = {}
        sources = {}
        for line in re.split(r"\n(?=\s*\w+\s*=\s)", self.rules.strip()):
            name, _, body = line.strip().partition("=")
            sources[name.strip()] = body
        nullable = self._nullable_rules(sources)
        for name in sources:
            self.known[("ref", name)] = Node(self, ("ref", name), name in nullable)
        for name, body in sources.items():
            self.bodies[name] = self._build(body)
        self.start = self.known[("ref", self.start_rule)]

    def fresh(self) -> Node:
        """The language of the grammar, after forgetting what has grown beyond the limit."""
        if self.made > self.limit:
            self.reset()
        return self.start

    def _nullable_rules(self, sources: dict[str, str]) -> set[str]:
        found: set[str] = set()
        while True:
            more = {name for name, body in sources.items() if self._parse(body, lambda kind, *x: self._is_nullable(found, kind, *x))}
            if more == found:
                return found
            found = more

    @staticmethod
    def _is_nullable(found: set[str], kind: str, *parts) -> bool:
        return {"set": lambda: False, "ref": lambda: parts[0] in found, "alt": lambda: any(parts[0]), "cat": lambda: all(parts[0]), "opt": lambda: True, "star": lambda: True}[kind]()

    def _build(self, body: str) -> Node:
        def make(kind: str, *parts):
            if kind == "set":
                return self._node(("set", frozenset(parts[0])), False)
            if kind == "ref":
                return self.known[("ref", parts[0])]
            if kind == "alt":
                return self.alt(tuple(parts[0]))
            if kind == "cat":
                out = self.eps
                for part in reversed(parts[0]):
                    out = self.cat(part, out)
                return out
            if kind == "opt":
                return self.alt((parts[0], self.eps))
            return self._node(("star", parts[0]), True)

        return self._parse(body, make)

    def _parse(self, body: str, make):
        items = self._ITEM.findall(body)
        at = 0

        def alternatives():
            nonlocal at
            options = [sequence()]
            while at < len(items) and items[at][2] == "|":
                at += 1
                options.append(sequence())
            return options[0] if len(options) == 1 else make("alt", options)

        def sequence():
            nonlocal at
            parts = []
            while at < len(items) and items[at][2] not in ("|", ")", "]", "}"):
                quoted, name, mark = items[at]
                at += 1
                if quoted:
                    parts.append(make("set", self.tokens.get(quoted, quoted)))
                elif name:
                    parts.append(make("set", self.sets[name]) if name in self.sets else make("ref", name))
                else:
                    inner = alternatives()
                    at += 1
                    parts.append({"(": lambda: inner, "[": lambda: make("opt", inner), "{": lambda: make("star", inner)}[mark]())
            return make("cat", parts)

        return alternatives()

    def _node(self, parts: tuple, nullable: bool) -> Node:
        node = self.known.get(parts)
        if node is None:
            node = self.known[parts] = Node(self, parts, nullable)
            self.made += 1
        return node

    def cat(self, head: Node, tail: Node) -> Node:
        if head is self.empty or tail is self.empty:
            return self.empty
        if head is self.eps:
            return tail
        if tail is self.eps:
            return head
        kind = head.parts[0]
        if kind == "star" and (tail is head or tail.parts[0] == "cat" and tail.parts[1] is head):
            return tail  # repeated twice in a row is repeated
        if kind == "cat":
            return self.cat(head.parts[1], self.cat(head.parts[2], tail))
        if kind == "alt":
            key = ("joined", head, tail)
            joined = self.known.get(key)
            if joined is None:
                joined = self.known[key] = self.alt([self.cat(option, tail) for option in head.parts[1]])
                self.made += 1
            return joined
        return self._node(("cat", head, tail), head.nullable and tail.nullable)

    def alt(self, options: list | tuple) -> Node:
        flat: set[Node] = set()
        for option in options:
            if option.parts[0] == "alt":
                flat |= option.parts[1]
            elif option is not self.empty:
                flat.add(option)
        if not flat:
            return self.empty
        if len(flat) == 1:
            return flat.pop()
        rests: dict[Node, list[Node]] = {}
        for option in flat:
            if option.parts[0] == "cat":
                rests.setdefault(option.parts[1], []).append(option.parts[2])
            else:
                rests.setdefault(option, []).append(self.eps)
        if len(rests) < len(flat):
            flat = {head if tails == [self.eps] else self.cat(head, self.alt(tails)) for head, tails in rests.items()}
            if len(flat) == 1:
                return flat.pop()
        return self._node(("alt", frozenset(flat)), any(x.nullable for x in flat))

    def word(self, state: Node, tokens: str) -> Node:
        """The derivative by a word of tokens, remembered as one step."""
        out = state
        for token in tokens:
            out = out[token]
        if len(tokens) < 200:
            state.words[tokens] = out
            self.made += 1
        return out
