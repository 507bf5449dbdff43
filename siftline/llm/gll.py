"""Generalised LL recognition over token strings, with a graph-structured stack.

A grammar is written as EBNF rules; each rule becomes a deterministic automaton over tokens
and rule calls, so a rule is a recursive transition network.  ``Recogniser.run`` explores all
alternatives at once: a descriptor is (state, stack node, position), a stack node is (rule,
position) with its return edges and the positions where it ended, so ambiguity, left recursion
and several dialects as alternatives of one start rule cost no backtracking.  One token of
lookahead drops descriptors that cannot go on.

Each token is one character.  Rules named in ``memo`` with a terminator are recognised once per
distinct token string: a result is kept under the text up to one token behind the next
terminator, and only if no token beyond it was looked at, so reuse is exact.
"""

from __future__ import annotations

import re

END = "\x01"  # behind the last token
NEVER = "\x02"  # a token that no lexer gives

_PART = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_]\w*)|([()|*+?]))")


class Grammar:
    """Rules as text: ``name = alternatives`` one a line or continued by indentation; 'x' and UPPER are tokens."""

    def __init__(self, text: str, start: str, memo: dict[str, str] | None = None, extra: tuple[str, ...] = ()):
        bodies: dict[str, str] = {}
        for m in re.finditer(r"(?m)^(\w+) = (.*(?:\n[ \t]+.*)*)", text):
            bodies[m.group(1)] = m.group(2)
        self.tokens: dict[str, str] = {}
        for t in extra:
            self.code(t)
        self.rules = list(bodies)
        self.number = {r: i for i, r in enumerate(self.rules)}
        self.start = self.number[start]
        self.begin: list[int] = []
        self.moves: list[dict[str, int]] = []  # by state: token -> state
        self.calls: list[list[tuple[int, int]]] = []  # by state: (rule, state)
        self.final: list[bool] = []
        self.rule_of: list[int] = []
        words = sorted({w for b in bodies.values() for w in re.findall(r"'([A-Za-z_]\w*)'", b)})
        for r in self.rules:
            body = bodies[r].replace("ANYWORD", "(NAME | " + " | ".join(f"'{w}'" for w in words) + ")")
            self._compile(r, body)
        self.words = {w: self.tokens[w] for w in words}
        self._sets()
        self.memo = {self.number[r]: self.tokens[t] for r, t in (memo or {}).items()}

    def code(self, token: str) -> str:
        if token not in self.tokens:
            self.tokens[token] = chr(33 + len(self.tokens))
        return self.tokens[token]

    def _compile(self, rule: str, body: str) -> None:
        parts = [m.groups() for m in _PART.finditer(body)]
        edges: list[list[tuple[object, int]]] = []
        at = 0

        def node() -> int:
            edges.append([])
            return len(edges) - 1

        def alternatives() -> tuple[int, int]:
            nonlocal at
            a, z = node(), node()
            while True:
                s, e = sequence()
                edges[a].append((None, s))
                edges[e].append((None, z))
                if at < len(parts) and parts[at][2] == "|":
                    at += 1
                    continue
                return a, z

        def sequence() -> tuple[int, int]:
            nonlocal at
            first = last = node()
            while at < len(parts) and parts[at][2] not in ("|", ")"):
                lit, name, sign = parts[at]
                at += 1
                if sign == "(":
                    s, e = alternatives()
                    assert parts[at][2] == ")", (rule, body)
                    at += 1
                else:
                    s, e = node(), node()
                    symbol = self.code(lit) if lit else self.number[name] if name in self.number else self.code(name) if name.isupper() else None
                    assert symbol is not None, (rule, name)
                    edges[s].append((symbol, e))
                while at < len(parts) and parts[at][2] in ("*", "+", "?"):
                    a, z = node(), node()
                    edges[a].append((None, s))
                    edges[e].append((None, z))
                    if parts[at][2] != "+":
                        edges[a].append((None, z))
                    if parts[at][2] != "?":
                        edges[e].append((None, s))
                    s, e = a, z
                    at += 1
                edges[last].append((None, s))
                last = e
            return first, last

        a, z = alternatives()
        assert at == len(parts), (rule, parts[at:])

        def closure(nodes: frozenset[int]) -> frozenset[int]:
            todo, out = list(nodes), set(nodes)
            while todo:
                for symbol, to in edges[todo.pop()]:
                    if symbol is None and to not in out:
                        out.add(to)
                        todo.append(to)
            return frozenset(out)

        states: dict[frozenset[int], int] = {}

        def state(nodes: frozenset[int]) -> int:
            if nodes not in states:
                states[nodes] = len(self.moves)
                self.moves.append({})
                self.calls.append([])
                self.final.append(z in nodes)
                self.rule_of.append(self.number[rule])
                todo.append(nodes)
            return states[nodes]

        todo: list[frozenset[int]] = []
        self.begin.append(state(closure(frozenset([a]))))
        while todo:
            nodes = todo.pop()
            k = states[nodes]
            by: dict[object, set[int]] = {}
            for n in nodes:
                for symbol, to in edges[n]:
                    if symbol is not None:
                        by.setdefault(symbol, set()).add(to)
            for symbol, to in by.items():
                target = state(closure(frozenset(to)))
                if isinstance(symbol, int):
                    self.calls[k].append((symbol, target))
                else:
                    self.moves[k][symbol] = target

    def _sets(self) -> None:
        n, m = len(self.rules), len(self.moves)
        first: list[set[str]] = [set() for _ in range(m)]  # by state
        empty = list(self.final)
        grew = True
        while grew:
            grew = False
            for k in range(m):
                f, e = set(self.moves[k]), self.final[k]
                for r, to in self.calls[k]:
                    f |= first[self.begin[r]]
                    if empty[self.begin[r]]:
                        f |= first[to]
                        e |= empty[to]
                if len(f) > len(first[k]) or e != empty[k]:
                    first[k], empty[k], grew = f | first[k], e or empty[k], True
        follow: list[set[str]] = [{END} if r == self.start else set() for r in range(n)]
        grew = True
        while grew:
            grew = False
            for k in range(m):
                for r, to in self.calls[k]:
                    f = set(first[to])
                    if empty[to]:
                        f |= follow[self.rule_of[k]]
                    if not f <= follow[r]:
                        follow[r] |= f
                        grew = True
        self.first, self.empty, self.follow = first, empty, follow


class Recogniser:
    def __init__(self, grammar: Grammar, kept: int = 400_000, longest: int = 300):
        self.g, self.kept, self.longest = grammar, kept, longest
        self.options: list[dict[str, tuple]] = [{} for _ in grammar.moves]
        self.cache: dict[tuple[int, str], tuple | None] = {}

    def _option(self, k: int, t: str) -> tuple:
        """(next state or -1, calls that can begin with t, whether the rule can end before t)."""
        g = self.g
        calls = []
        for r, to in g.calls[k]:
            b = g.begin[r]
            if t in g.first[b] or (g.empty[b] and (t in g.first[to] or (g.empty[to] and t in g.follow[g.rule_of[k]]))):
                calls.append((r, to))
        o = (g.moves[k].get(t, -1), tuple(calls), g.final[k] and t in g.follow[g.rule_of[k]])
        self.options[k][t] = o
        return o

    def accepts(self, tokens: str) -> bool:
        s = tokens + END + END
        try:
            ends, _ = self.run(self.g.start, s, 0, True)
        except RecursionError:  # nested too deep for memoised calls: the plain stack takes any depth
            ends, _ = self.run(self.g.start, s, 0, False)
        return len(tokens) in ends

    def remembered(self, r: int, s: str, p: int) -> tuple | None:
        stop = s.find(self.g.memo[r], p)
        if stop < 0:
            stop = len(s) - 2
        if stop - p > self.longest:
            return None
        key = (r, s[p : stop + 2])
        if key in self.cache:
            return self.cache[key]
        ends, far = self.run(r, s, p, True)
        if len(self.cache) > self.kept:
            self.cache.clear()
        found = (tuple(e - p for e in ends), far - p) if far <= stop + 1 else None
        self.cache[key] = found
        return found if found is not None else (tuple(e - p for e in ends), far - p)

    def run(self, rule: int, s: str, p: int, memo: bool) -> tuple[set[int], int]:
        """Where the rule can end if it begins at p, and the last position looked at."""
        options, begin = self.options, self.g.begin
        memos = self.g.memo if memo else {}
        ends: set[int] = set()
        nodes: dict[tuple[int, int], tuple] = {}
        seen: set = set()
        root = ([], [])
        work = [(begin[rule], root, p)]
        far = p
        while work:
            k, node, p = work.pop()
            while True:
                if p > far:
                    far = p
                t = s[p]
                o = options[k].get(t)
                if o is None:
                    o = self._option(k, t)
                to, calls, ends_here = o
                if to >= 0 and not calls and not ends_here:
                    k = to
                    p += 1
                    continue
                ahead = None
                if to >= 0:
                    ahead = (to, node, p + 1)
                for r, back in calls:
                    if r in memos:
                        found = self.remembered(r, s, p)
                        if found is not None:
                            if p + found[1] > far:
                                far = p + found[1]
                            for e in found[0]:
                                x = (back, id(node), p + e)
                                if x not in seen:
                                    seen.add(x)
                                    if ahead is not None:
                                        work.append(ahead)
                                    ahead = (back, node, p + e)
                            continue
                    key = (r, p)
                    child = nodes.get(key)
                    if child is None:
                        child = nodes[key] = ([(back, node)], [])
                        if ahead is not None:
                            work.append(ahead)
                        ahead = (begin[r], child, p)
                    elif not any(b == back and n is node for b, n in child[0]):
                        child[0].append((back, node))
                        for e in child[1]:
                            x = (back, id(node), e)
                            if x not in seen:
                                seen.add(x)
                                work.append((back, node, e))
                if ends_here:
                    if node is root:
                        ends.add(p)
                    elif p not in node[1]:
                        node[1].append(p)
                        for back, up in node[0]:
                            x = (back, id(up), p)
                            if x not in seen:
                                seen.add(x)
                                if ahead is not None:
                                    work.append(ahead)
                                ahead = (back, up, p)
                if ahead is None:
                    break
                k, node, p = ahead
        return ends, far
