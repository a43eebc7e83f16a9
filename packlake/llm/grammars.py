"""Token streams and grammars of the languages whose files are parsed.

A language gives, for a text, its tokens as words of one character per token, one word per line, and the grammar they are checked with.
White space and comments are no tokens; a character no token can hold becomes ``?``, which no grammar accepts.
"""

from __future__ import annotations

import re

from packlake.llm.derivatives import Grammar, Node

#: Classified tokens that a worker remembers per language.
REMEMBERED = 100_000


class Classes(dict):
    """Token text to token character, learnt as texts come."""

    def __init__(self, fixed: dict[str, str], other):
        super().__init__(fixed)
        self.fixed, self.other = fixed, other

    def __missing__(self, text: str) -> str:
        found = self.other(text)
        if len(text) <= 24:
            if len(self) > REMEMBERED:
                self.clear()
                self.update(self.fixed)
            self[text] = found
        return found


def letters(names: str, start: int = 0x4E00) -> dict[str, str]:
    """A character of its own for each name."""
    return {name: chr(start + i) for i, name in enumerate(names.split())}


class Verdict:
    """What parsing a text gave: whether it is valid, the line of the token at fault, and whether the text broke off."""

    __slots__ = ("line", "truncated", "valid")

    def __init__(self, valid: bool, line: int | None = None, truncated: bool = False):
        self.valid, self.line, self.truncated = valid, line, truncated


def run(grammar: Grammar, words: list[str], state: Node | None = None) -> tuple[Node, int | None]:
    """The last derivative, and the index of the word that emptied it."""
    state = state or grammar.fresh()
    empty = grammar.empty
    for i, word in enumerate(words):
        after = state.words.get(word)
        if after is None:
            after = grammar.word(state, word)
        if after is empty:
            return after, i
        state = after
    return state, None


class Language:
    """Tokens and grammar of a language in which lines may end anywhere."""

    token: re.Pattern
    grammar: Grammar
    classes: Classes

    def words(self, text: str) -> list[str]:
        return "".join(map(self.classes.__getitem__, self.token.findall(text))).split("\n")

    def parse(self, text: str) -> Verdict:
        state, at = run(self.grammar, self.words(text))
        if at is not None:
            return Verdict(False, at + 1)
        return Verdict(True) if self.ended(state) else Verdict(False, None, True)

    def ended(self, state: Node) -> bool:
        return state.nullable


# --------------------------------------------------------------------------------------------------------------- JSON


class Json(Language):
    """Strict JSON."""

    token = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[A-Za-z]+|[^ \t\r]', re.A)
    grammar = Grammar(
        """
        start = value
        value = 's' | 'v' | '{' [ pair { ',' pair } ] '}' | '[' [ value { ',' value } ] ']'
        pair = 's' ':' value
        """,
        {},
        {},
    )

    def __init__(self):
        def other(text: str) -> str:
            if len(text) > 1 and text[0] == '"':
                return "s"
            return "v" if text[0] in "-0123456789" and text != "-" else "?"

        self.classes = Classes({"true": "v", "false": "v", "null": "v", "\n": "\n"} | {c: c for c in "{}[]:,"}, other)


# --------------------------------------------------------------------------------------------------------------- TOML

_TOML_VALUE = re.compile(
    r"[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|true|false"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?"
)
_TOML_KEY = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")


class Toml(Language):
    """TOML 1.0; keys set twice are no matter of grammar and are looked for after it."""

    token = re.compile(
        r'"""(?:[^\\"]|\\[\s\S]|"(?!""))*"{3,5}|' + r"'''(?:[^']|'(?!''))*'{3,5}|" + r'"(?:[^"\\\n\x00-\x08]|\\["\\bfnrtue]|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})*"|' + r"'[^'\n]*'|#[^\n]*|"
        r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?|[A-Za-z0-9_+-](?:[A-Za-z0-9_.:+-]*[A-Za-z0-9_+-])?|\[\[|\]\]|[^ \t\r]"
    )
    grammar = Grammar(
        """
        start = { 'n' } [ line { nl line } { 'n' } ]
        nl = 'n' { 'n' }
        line = key '=' value | '[' key ']' | '[[' key ']]'
        key = KEY { '.' KEY }
        value = STRING | MULTI | VALUE | array | inline
        array = '[' { 'n' } [ value { 'n' } { ',' { 'n' } value { 'n' } } [ ',' { 'n' } ] ] close | '[[' { 'n' } [ value { 'n' } { ',' { 'n' } value { 'n' } } [ ',' { 'n' } ] ] close { 'n' } { ',' { 'n' } value { 'n' } } [ ',' { 'n' } ] close | '[[' { 'n' } [ value { 'n' } { ',' { 'n' } value { 'n' } } [ ',' { 'n' } ] ] ']]'
        close = ']'
        inline = '{' [ key '=' value { ',' key '=' value } ] '}'
        """,
        {"[[": "〔", "]]": "〕"},
        {"KEY": "kbs", "VALUE": "vb", "STRING": "s", "MULTI": "m"},
    )

    def __init__(self):
        def other(text: str) -> str:
            first = text[0]
            if first == "#":
                return ""
            if first in "\"'":
                return ("m" + "\n" * text.count("\n") if len(text) >= 6 and text[:3] in ('"""', "'''") else "s") if len(text) > 1 else "?"
            value, key = _TOML_VALUE.fullmatch(text), _TOML_KEY.fullmatch(text)
            return "b" if value and key else "v" if value else "k" if key else "?"

        # a closing pair of brackets may also close two arrays
        self.classes = Classes({"\n": "n\n", "[[": "〔", "]]": "〕"} | {c: c for c in "[]{}=,."}, other)

    def words(self, text: str) -> list[str]:
        out, depth = [], 0
        for word in super().words(text):
            if depth or "〔" in word[1:] or ("〕" in word and word[:1] != "〔"):  # inside a value each bracket stands for itself
                word = word.replace("〕", "]]") if depth or word[:1] != "〔" else word
                word = word[:1] + word[1:].replace("〔", "[[")
                if depth and word[:1] == "〔":
                    word = "[[" + word[1:]
            depth = max(0, depth + word.count("[") - word.count("]") + (2 if "〔" in word else 0) - (2 if "〕" in word else 0))
            out.append(word)
        return out


# --------------------------------------------------------------------------------------------------------------- Python

_PY = letters(
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False match case type "
    "-> := ** // << >> <= >= == != += -= *= /= //= %= &= |= ^= >>= <<= **= @= ... INDENT DEDENT NL"
)
_PY_NUMBER = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]|\d(?:_?\d)*\.(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*)")
_PY_STRING = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"


class Python(Language):
    """Python 3."""

    token = re.compile(
        _PY_STRING + r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + _PY_STRING + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|" + _PY_STRING + r'"(?!"")(?:[^"\\\n]|\\[\s\S])*"|' + _PY_STRING + r"'(?!'')(?:[^'\\\n]|\\[\s\S])*'|"
        r"\n(?:[ \t\f\r]*(?:#[^\n]*)?\n)*[ \t\f]*|#[^\n]*|\\\r?\n[ \t]*|(?:\d|\.\d)(?:[\w.]|(?<=[eE])[+-](?=\d))*|\w+|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%&|^@]=|[^ \t\f\r]"
    )
    grammar = Grammar(
        """
        start = { statement }
        statement = simple { ';' simple } [ ';' ] 'NL' | compound
        simple = assignment | 'pass' | 'break' | 'continue' | 'return' [ exprs ] | 'raise' [ test [ 'from' test ] ] | 'del' exprs | 'assert' test [ ',' test ] | imports | ( 'global' | 'nonlocal' ) NAME { ',' NAME } | 'type' NAME [ typeparams ] '=' test
        assignment = exprs { '=' ( exprs | yields ) } | operand AUG ( exprs | yields ) | operand ':' test [ '=' ( exprs | yields ) ] | yields { '=' ( exprs | yields ) }
        imports = 'import' dotted [ 'as' NAME ] { ',' dotted [ 'as' NAME ] } | 'from' ( DOTS { DOTS } [ dotted ] | dotted ) 'import' ( '*' | names | '(' names [ ',' ] ')' )
        names = NAME [ 'as' NAME ] { ',' NAME [ 'as' NAME ] }
        dotted = NAME { '.' NAME }
        yields = 'yield' [ 'from' test | exprs ]
        exprs = starred { ',' starred } [ ',' ]
        starred = '*' binary | named
        named = test | NAME ':=' test
        test = binary [ 'if' binary 'else' test ] | lambda
        lambda = 'lambda' [ params ] ':' test
        binary = operand { BINOP operand | ( 'not' 'in' | 'is' 'not' ) operand }
        operand = { UNARY } atom { trailer }
        atom = NAME | NUMBER | STRING { STRING } | CONST | '(' [ group ] ')' | '[' [ group1 ] ']' | '{' [ braces ] '}'
        group = yields | starred ( comp | { ',' starred } [ ',' ] )
        group1 = starred ( comp | { ',' starred } [ ',' ] )
        braces = starred ( comp | { ',' starred } [ ',' ] ) | entry ( comp | { ',' entry } [ ',' ] )
        entry = test ':' test | '**' binary
        comp = [ 'async' ] 'for' targets 'in' binary { 'if' ( binary | lambda | NAME ':=' test ) | [ 'async' ] 'for' targets 'in' binary } [ 'if' binary 'else' test { 'if' binary } ]
        targets = target { ',' target } [ ',' ]
        target = [ '*' ] operand
        trailer = '(' [ args ] ')' | '[' subs ']' | '.' NAME
        args = arg { ',' arg } [ ',' ]
        arg = ( named [ comp ] | NAME '=' test | '*' test | '**' test )
        subs = sub { ',' sub } [ ',' ]
        sub = starred | [ test ] ':' [ test ] [ ':' [ test ] ]
        compound = { '@' named 'NL' } ( function | class ) | if | while | for | try | with | match | 'async' ( for | with )
        function = [ 'async' ] 'def' NAME [ typeparams ] '(' [ tparams ] ')' [ '->' test ] ':' suite
        typeparams = '[' tparam { ',' tparam } [ ',' ] ']'
        tparam = [ STARS ] NAME [ ':' test ] [ '=' test ]
        class = 'class' NAME [ typeparams ] [ '(' [ args ] ')' ] ':' suite
        params = param { ',' param } [ ',' ]
        param = NAME [ '=' test ] | '*' [ NAME ] | '**' NAME | '/'
        tparams = typed { ',' typed } [ ',' ]
        typed = NAME [ ':' test ] [ '=' test ] | '*' [ NAME [ ':' starred ] ] | '**' NAME [ ':' test ] | '/'
        if = 'if' named ':' suite { 'elif' named ':' suite } [ 'else' ':' suite ]
        while = 'while' named ':' suite [ 'else' ':' suite ]
        for = 'for' targets 'in' exprs ':' suite [ 'else' ':' suite ]
        try = 'try' ':' suite ( except { except } [ 'else' ':' suite ] [ 'finally' ':' suite ] | 'finally' ':' suite )
        except = 'except' [ '*' ] [ test [ 'as' NAME ] ] ':' suite
        with = 'with' ( item { ',' item } | '(' item { ',' item } [ ',' ] ')' ) ':' suite
        item = test [ 'as' target ]
        match = 'match' exprs ':' 'NL' 'INDENT' case { case } 'DEDENT'
        case = 'case' patterns [ 'if' named ] ':' suite
        patterns = starred1 { ',' starred1 } [ ',' ]
        starred1 = '*' NAME | pattern
        pattern = closed { '|' closed } [ 'as' NAME ]
        closed = [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | STRING { STRING } | CONST | NAME { '.' NAME } [ '(' [ parg { ',' parg } [ ',' ] ] ')' ] | '(' [ patterns ] ')' | '[' [ patterns ] ']' | '{' [ pair { ',' pair } [ ',' ] ] '}'
        parg = pattern | NAME '=' pattern
        pair = closed ':' pattern | '**' NAME
        suite = simple { ';' simple } [ ';' ] 'NL' | 'NL' 'INDENT' statement { statement } 'DEDENT'
        """,
        _PY,
        {
            "NAME": "a" + _PY["match"] + _PY["case"] + _PY["type"],
            "NUMBER": "1",
            "STRING": "s",
            "CONST": _PY["None"] + _PY["True"] + _PY["False"] + _PY["..."],
            "DOTS": "." + _PY["..."],
            "STARS": "*" + _PY["**"],
            "UNARY": "-+~" + _PY["not"] + _PY["await"],
            "BINOP": "+-*/%@&|^<>" + "".join(_PY[x] for x in "** // << >> <= >= == != and or in is".split()),
            "AUG": "".join(_PY[x] for x in "+= -= *= /= //= %= &= |= ^= >>= <<= **= @=".split()),
        },
    )

    def __init__(self):
        self.columns: dict[str, tuple[int, int]] = {}
        self.column_of: dict[tuple[int, int], str] = {}
        self.delta: dict[str, int] = {}

        def other(text: str) -> str:
            first = text[0]
            if first == "\n":
                return "\n" * text.count("\n") + self._column(text[text.rfind("\n") + 1 :])
            if first == "#" or first == "\\" and len(text) > 1:
                return "\x01" if first == "\\" else ""
            if text[-1] in "\"'" and len(text) > 1:
                return "s" + "\x01" * text.count("\n")
            if first.isdigit() or first == "." and len(text) > 1 and text[1].isdigit():
                return self._number(text)
            return "a" if text.isidentifier() else "?"

        self.classes = Classes({k: v for k, v in _PY.items() if k not in ("INDENT", "DEDENT", "NL")} | {c: c for c in "()[]{}:;,.=+-*/%@&|^<>~"}, other)

    @staticmethod
    def _number(text: str) -> str:
        if _PY_NUMBER.fullmatch(text):
            return "1"
        m = re.match(r"(\d[\d_.]*?(?:[eE]\d+)?|0[xX][0-9a-fA-F]+?)(if|else|and|or|in|is|for|not)$", text)
        return "1" + _PY[m[2]] if m else "1?"

    def _column(self, blanks: str) -> str:
        eight = one = 0
        for c in blanks:
            if c == "\t":
                eight, one = (eight // 8 + 1) * 8, one + 1
            elif c == "\f":
                eight = one = 0
            else:
                eight, one = eight + 1, one + 1
        key = (eight, one)
        mark = self.column_of.get(key)
        if mark is None:
            mark = self.column_of[key] = chr(0xE000 + len(self.column_of))
            self.columns[mark] = key
        return mark

    def parse(self, text: str) -> Verdict:
        if text.startswith("\ufeff"):
            text = text[1:]
        if "\0" in text:
            return Verdict(False, 1)
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        grammar, delta = self.grammar, self.delta
        state, empty = grammar.fresh(), grammar.empty
        indent, dedent, newline = _PY["INDENT"], _PY["DEDENT"], _PY["NL"]
        stack, depth, number = [(0, 0)], 0, 0
        if len(delta) > REMEMBERED:
            delta.clear()
        for word in "".join(map(self.classes.__getitem__, self.token.findall("\n" + text))).split("\n"):
            number += 1
            if not word:
                continue
            mark, line = word[0], word[1:]
            if not "\ue000" <= mark <= "\uf8ff":
                mark, line = "", word
            if "\x01" in line:
                number += line.count("\x01")
                line = line.replace("\x01", "")
            if not line:
                continue
            before = depth
            change = delta.get(line)
            if change is None:
                change = delta[line] = sum(map(line.count, "([{")) - sum(map(line.count, ")]}"))
            depth += change
            if not before:
                column = self.columns[mark] if mark else stack[-1]
                if column != stack[-1]:
                    top = stack[-1]
                    if column[0] > top[0] and column[1] > top[1]:
                        stack.append(column)
                        line = indent + line
                    elif column[0] < top[0] and column[1] < top[1]:
                        while stack[-1][0] > column[0]:
                            stack.pop()
                            line = dedent + line
                        if stack[-1] != column:
                            return Verdict(False, number - 1)
                    else:
                        return Verdict(False, number - 1)
            if depth <= 0:
                depth = 0
                line += newline
            after = state.words.get(line)
            if after is None:
                after = grammar.word(state, line)
            if after is empty:
                return Verdict(False, number - 1)
            state = after
        if depth:
            return Verdict(False, None, True)
        for _ in stack[1:]:
            state = state[dedent]
        return Verdict(True) if state.nullable else Verdict(False, None, True)
