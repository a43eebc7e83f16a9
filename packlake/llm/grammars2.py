"""Token streams and grammars of JavaScript, TypeScript, Bash and YAML."""

from __future__ import annotations

import re

from packlake.llm.derivatives import Grammar, Node
from packlake.llm.grammars import Classes, Language, Verdict, letters, run

# --------------------------------------------------------------------------------------------------------- JavaScript

_JS = letters(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum "
    "let static yield async await of get set from as "
    "type interface namespace module declare abstract public private protected readonly implements keyof unique infer is asserts satisfies override accessor global "
    "=> ... ?. ?? ** ++ -- && || == != === !== <= >= << += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= END"
)
_JS_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
_JS_CONTEXT = "let static yield async await of get set from as".split()
_TS_CONTEXT = "type interface namespace module declare abstract public private protected readonly implements keyof unique infer is asserts satisfies override accessor global".split()
_END = _JS["END"]


def _chars(names: str) -> str:
    return "".join(_JS.get(n, n) for n in names.split())


_SETS = {
    "NAME": "a" + _chars(" ".join(_JS_CONTEXT + _TS_CONTEXT)),
    "PROP": "a" + _chars(" ".join(_JS_CONTEXT + _TS_CONTEXT + _JS_RESERVED)),
    "NUMBER": "1",
    "STRING": "s",
    "TEMPLATE": "t",
    "LITERAL": "1strq" + _chars("this null true false super"),
    "BINOP": "+-*/%&|^<" + _chars("** && || ?? == != === !== <= >= << in instanceof"),
    "ASSIGN": "=" + _chars("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??="),
    "PREFIX": "+-!~" + _chars("++ -- typeof void delete await"),
    "STEP": _chars("++ --"),
    "ACCESS": _chars("public private protected readonly static override abstract declare accessor async"),
    "VAR": _chars("var let const"),
    "STOP": ";" + _END,
}

_COMMON = """
        block = '{' { statement } '}'
        body = block | assign
        while = 'while' '(' expr ')' statement
        do = 'do' statement 'while' '(' expr ')' [ STOP ]
        if = 'if' '(' expr ')' statement [ { END } 'else' statement ]
        for = 'for' [ 'await' ] '(' ( [ VAR bindings | expr ] ';' [ expr ] ';' [ expr ] | VAR bindtarget ( 'of' assign | 'in' expr ) | operand ( 'of' assign | 'in' expr ) ) ')' statement
        switch = 'switch' '(' expr ')' '{' { 'case' expr ':' { statement } } [ 'default' ':' { statement } { 'case' expr ':' { statement } } ] '}'
        try = 'try' block ( catch [ finally ] | finally )
        finally = 'finally' block
        label = NAME ':' statement
        bindings = binding { ',' binding }
        bindtarget = NAME | pattern
        pattern = '[' [ [ element ] { ',' [ element ] } ] ']' | '{' [ field { ',' field } [ ',' ] ] '}'
        element = '...' bindtarget | bindtarget [ '=' assign ]
        field = '...' NAME | NAME [ '=' assign ] | propname ':' bindtarget [ '=' assign ]
        propname = PROP | STRING | NUMBER | '[' assign ']'
        expr = assign { ',' assign }
        yieldexpr = 'yield' [ '*' ] assign
        ternary = '?' assign ':' assign
        shift = '>' [ '>' [ '>' ] ]
        object = '{' [ member { ',' member } [ ',' ] ] '}'
        array = '[' [ [ item ] { ',' [ item ] } ] ']'
        item = [ '...' ] assign
        args = '(' [ item { ',' item } [ ',' ] ] ')'
        import = 'import' ( STRING [ with ] | clause 'from' STRING [ with ] ) STOP
        with = ( 'with' | NAME ) object
        clause = ( NAME | '*' 'as' NAME | named ) [ ',' ( '*' 'as' NAME | named ) ]
        specifier = ( PROP | STRING ) [ 'as' ( PROP | STRING ) ]
        reexport = 'export' ( '*' [ 'as' ( PROP | STRING ) ] 'from' STRING [ with ] | named [ 'from' STRING [ with ] ] ) STOP
"""

_JS_RULES = (
    """
        start = [ '#' ] { statement }
        statement = block | STOP1 | ( VAR bindings | exprstart | 'return' [ expr ] | 'throw' expr | ( 'break' | 'continue' ) [ NAME ] | 'debugger' ) STOP | if | for | while | do | switch | try | label | function | class | import | reexport | export
        export = 'export' ( VAR bindings STOP | function | class | 'default' ( function0 | class0 | plainassign STOP ) )
        named = '{' [ specifier { ',' specifier } [ ',' ] ] '}'
        catch = 'catch' [ '(' bindtarget ')' ] block
        binding = bindtarget [ '=' assign ]
        exprstart = plainassign { ',' assign }
        plainassign = arrow | yieldexpr | ( plain { postfix } | PREFIX operand ) { tail }
        assign = arrow | yieldexpr | operand { tail }
        tail = BINOP operand | shift operand | ASSIGN assign | ternary
        operand = { PREFIX } ( plain | object | function0 | class0 ) { postfix }
        plain = NAME | LITERAL | '(' expr ')' | array | 'new' new | 'import' ( '(' assign [ ',' assign ] [ ',' ] ')' | '.' NAME ) | PRIVATE 'in' operand
        new = 'new' new | '.' NAME | { PREFIX0 } ( NAME | LITERAL | '(' expr ')' | function0 | class0 | array ) { '.' ( PROP | PRIVATE ) | '[' expr ']' | TEMPLATE } [ args ]
        postfix = '.' ( PROP | PRIVATE ) | '?.' ( PROP | PRIVATE | '[' expr ']' | args ) | '[' expr ']' | args | TEMPLATE | STEP
        arrow = [ 'async' ] ( NAME | '(' [ param { ',' param } [ ',' ] ] ')' ) '=>' body
        param = '...' bindtarget | bindtarget [ '=' assign ]
        params = '(' [ param { ',' param } [ ',' ] ] ')'
        function = [ 'async' ] 'function' [ '*' ] NAME params block
        function0 = [ 'async' ] 'function' [ '*' ] [ NAME ] params block
        class = 'class' NAME [ 'extends' operand ] classbody
        class0 = 'class' [ NAME ] [ 'extends' operand ] classbody
        classbody = '{' { ';' | classmember } '}'
        classmember = [ 'static' ] ( [ 'async' ] [ '*' ] ( propname | PRIVATE ) params block | ( 'get' | 'set' ) ( propname | PRIVATE ) params block | ( propname | PRIVATE ) [ '=' assign ] STOP ) | 'static' block
        member = '...' assign | NAME [ '=' assign ] | propname ':' assign | [ 'async' ] [ '*' ] propname params block | ( 'get' | 'set' ) propname params block
    """
    + _COMMON
)

_TS_RULES = (
    """
        start = [ '#' ] { statement }
        statement = block | STOP1 | ( VAR bindings | exprstart | 'return' [ expr ] | 'throw' expr | ( 'break' | 'continue' ) [ NAME ] | 'debugger' ) STOP | if | for | while | do | switch | try | label | { decorator } function | { decorator } class | import | reexport | export | declaration | importtype
        export = 'export' ( VAR bindings STOP | function | { decorator } class | 'default' ( function0 | class0 | interface | plainassign STOP ) | declaration | '=' expr STOP | 'as' 'namespace' NAME STOP )
        importtype = 'import' ( 'type' clause 'from' STRING [ with ] | NAME '=' expr ) STOP | 'export' 'type' ( named [ 'from' STRING ] | '*' [ 'as' NAME ] 'from' STRING ) STOP
        named = '{' [ [ 'type' ] specifier { ',' [ 'type' ] specifier } [ ',' ] ] '}'
        declaration = 'type' NAME [ generics ] '=' type STOP | interface | [ 'const' ] 'enum' NAME '{' [ enumitem { ',' enumitem } [ ',' ] ] '}' | 'abstract' class | ( 'namespace' | 'module' ) ( NAME { '.' NAME } | STRING ) block | 'global' block | 'declare' ( VAR bindings STOP | function | class | declaration | ( 'module' STRING STOP ) )
        interface = 'interface' NAME [ generics ] [ 'extends' typeref { ',' typeref } ] typebody
        enumitem = propname [ '=' assign ]
        catch = 'catch' [ '(' bindtarget [ ':' type ] ')' ] block
        binding = bindtarget [ '!' ] [ ':' type ] [ '=' assign ]
        exprstart = plainassign { ',' assign }
        plainassign = arrow | yieldexpr | ( plain { postfix } | PREFIX operand ) { tail }
        assign = arrow | yieldexpr | operand { tail }
        tail = BINOP operand | shift operand | ASSIGN assign | ternary | 'as' ( type | 'const' ) | 'satisfies' type
        operand = { PREFIX | '<' type '>' } ( plain | object | function0 | class0 ) { postfix }
        plain = NAME | LITERAL | '(' expr ')' | array | 'new' new | 'import' ( '(' assign [ ',' assign ] [ ',' ] ')' | '.' NAME ) | PRIVATE 'in' operand
        new = 'new' new | '.' NAME | ( NAME | LITERAL | '(' expr ')' | function0 | class0 | array ) { '.' ( PROP | PRIVATE ) | '[' expr ']' | TEMPLATE } [ typeargs ] [ args ]
        postfix = '.' ( PROP | PRIVATE ) | '?.' ( PROP | PRIVATE | '[' expr ']' | [ typeargs ] args ) | '[' expr ']' | args | TEMPLATE | STEP | '!' | typeargs ( args | TEMPLATE )
        arrow = [ 'async' ] ( NAME | [ generics ] '(' [ param { ',' param } [ ',' ] ] ')' [ ':' returns ] ) '=>' body
        param = { decorator } ( { ACCESS } ( '...' bindtarget | bindtarget ) [ '?' ] [ ':' type ] [ '=' assign ] | 'this' ':' type )
        params = '(' [ param { ',' param } [ ',' ] ] ')'
        signature = [ generics ] params [ ':' returns ]
        function = [ 'async' ] 'function' [ '*' ] NAME signature ( block | STOP )
        function0 = [ 'async' ] 'function' [ '*' ] [ NAME ] signature block
        heritage = [ 'extends' operand [ typeargs ] ] [ 'implements' typeref { ',' typeref } ]
        class = [ 'abstract' ] 'class' NAME [ generics ] heritage classbody
        class0 = [ 'abstract' ] 'class' [ NAME ] [ generics ] heritage classbody
        decorator = '@' ( NAME { '.' PROP } [ args ] | '(' expr ')' )
        classbody = '{' { ';' | { decorator } classmember } '}'
        classmember = { ACCESS } ( [ '*' ] ( propname | PRIVATE ) [ '?' ] signature ( block | STOP ) | ( 'get' | 'set' ) ( propname | PRIVATE ) signature ( block | STOP ) | ( propname | PRIVATE ) [ '?' | '!' ] [ ':' type ] [ '=' assign ] STOP | '[' NAME ':' type ']' ':' type STOP ) | 'static' block
        member = '...' assign | NAME [ '=' assign ] | propname ':' assign | [ 'async' ] [ '*' ] propname signature block | ( 'get' | 'set' ) propname signature block
        generics = '<' generic { ',' generic } [ ',' ] '>'
        generic = [ 'const' ] [ 'in' ] NAME [ 'extends' type ] [ '=' type ]
        typeargs = '<' type { ',' type } '>'
        typeref = ( NAME | 'this' ) { '.' PROP } [ typeargs ]
        returns = type | [ 'asserts' ] ( NAME | 'this' ) [ 'is' type ]
        type = functype | [ '|' | '&' ] typeop { ( '|' | '&' ) typeop } [ 'extends' type '?' type ':' type ]
        functype = [ 'abstract' ] [ 'new' ] [ generics ] params '=>' returns
        typeop = { 'keyof' | 'unique' | 'readonly' | 'infer' } ( typeprim | 'typeof' typequery ) { '[' [ type ] ']' } | functype
        typequery = ( NAME | 'this' | 'import' '(' type ')' ) { '.' PROP } [ typeargs ]
        typeprim = typeref | TYPELITERAL | '-' NUMBER | typebody | '[' [ tuple { ',' tuple } [ ',' ] ] ']' | '(' type ')' | 'import' '(' type ')' { '.' PROP } [ typeargs ] | mapped
        tuple = [ '...' ] [ NAME [ '?' ] ':' ] type [ '?' ]
        typebody = '{' { END } [ typemember { separator typemember } [ separator ] ] '}'
        separator = ( ';' | ',' | END ) { ';' | END }
        typemember = { ACCESS } ( ( 'get' | 'set' ) propname params [ ':' returns ] | propname [ '?' ] ( signature | [ ':' type ] ) | '[' NAME ':' type ']' ':' type ) | [ 'new' ] signature
        mapped = '{' [ [ '+' | '-' ] 'readonly' ] '[' NAME 'in' type [ 'as' type ] ']' [ [ '+' | '-' ] '?' ] ':' type [ STOP ] '}'
    """
    + _COMMON
)

_JS_SETS = _SETS | {"PRIVATE": "p", "END": _END, "STOP1": ";", "PREFIX0": "\x00", "TYPELITERAL": "1st" + _chars("this null true false void")}


class JavaScript(Language):
    """JavaScript, as a module or as a script; a line end may stand for a semicolon where a statement can end."""

    #: An operator or bracket, after which a slash begins a regular expression, is read together with it.
    token = re.compile(
        r"//[^\n]*|/\*[\s\S]*?\*/|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{(?:[^{}`]|\{[^{}]*\})*\}|`(?:[^`\\]|\\[\s\S])*`)*\})*`|" + r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|' + r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|"
        r"(?:[(,=:\[!&|?{};+*%~^<>-]|=>|\breturn|\btypeof|\bcase|\bin|\bof)[ \t]*/(?![/*=])(?:[^\n/\\\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*|"
        r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?|#?[\w$\u0080-￿\U00010000-\U0010ffff]+|"
        r">>>=|>>=|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\.\.\.|=>|\?\.(?!\d)|\?\?|\*\*|\+\+|--|&&|\|\||==|!=|<=|>=|<<|[-+*/%&|^]=|[^ \t\r\f\v﻿]"
    )
    grammar = Grammar(_JS_RULES, _JS, _JS_SETS)
    context = _JS_CONTEXT

    def __init__(self):
        known = {k: v for k, v in _JS.items() if k in _JS_RESERVED + self.context or not k[0].isalpha()}
        known.pop("END", None)
        punctuation = {c: c for c in "(){}[];,<>+-*/%&|^!~?:=.@"}

        def other(text: str) -> str:
            first = text[0]
            if first == "\n":
                return "\n"
            if text.startswith(("//", "/*")):
                return "\n" * text.count("\n")
            if len(text) > 1:
                if first in "\"'":
                    return "s" + "\x02" * text.count("\n")
                if first == "`":
                    return "t" + "\x02" * text.count("\n")
                if text[-1] == "/" or re.search(r"/[a-z]*$", text):
                    m = re.match(r"(=>|[a-z]+|[^\w\s])[ \t]*(/.*)$", text, re.S)
                    if m:
                        return self.classes[m[1]] + "r"
            if first.isdigit() or first == "." and len(text) > 1:
                return "1"
            if first == "#":
                return ("p" if text[1:].replace("$", "a").isidentifier() else "?") if len(text) > 1 else "?"
            return "a" if text.replace("$", "a").isidentifier() else "?"

        self.classes = Classes(known | punctuation, other)

    def parse(self, text: str) -> Verdict:
        if text.startswith("#!"):
            text = "//" + text[2:]
        grammar = self.grammar
        state, empty = grammar.fresh(), grammar.empty
        number = 0
        for word in self.words(text):
            number += 1
            if not word:
                continue
            if "\x02" in word:
                number += word.count("\x02")
                word = word.replace("\x02", "")
            after = state.words.get(word)
            if after is None:
                after = self.line(state, word)
            if after is empty:
                return Verdict(False, number)
            state = after
        return Verdict(True) if state.nullable or state[_END].nullable else Verdict(False, None, True)

    def line(self, state: Node, word: str) -> Node:
        """The derivative by a line and its end, where semicolons may be missing before its end and before a closing brace."""
        grammar, out = self.grammar, state
        for token in word:
            if token == "}":
                out = grammar.alt((out[token], out[_END][token]))
            else:
                out = out[token]
        out = grammar.alt((out, out[_END]))
        if len(word) < 200:
            state.words[word] = out
            grammar.made += 1
        return out


class TypeScript(JavaScript):
    """TypeScript."""

    grammar = Grammar(_TS_RULES, _JS, _JS_SETS)
    context = _JS_CONTEXT + _TS_CONTEXT


# --------------------------------------------------------------------------------------------------------------- Bash

_SH = letters("if then elif else fi for while until do done case esac in function select time coproc && || ;; |& << >> <<< >| <> >& <& &> &>> (( [[ ]]", 0x5E00)
_SH_WORDS = "if then elif else fi for while until do done case esac in function select time coproc".split()
_QUOTES = r"'[^']*'"
_SUB0 = r"(?:[^()'\"\\]|\\[\s\S]|'[^']*'|\"(?:[^\"\\]|\\[\s\S])*\")"
_SUB1 = rf"\((?:{_SUB0}|\({_SUB0}*\))*\)"
_SUB2 = rf"\((?:{_SUB0}|{_SUB1})*\)"
_BRACE0 = r"(?:[^{}'\"\\]|\\[\s\S]|'[^']*'|\"(?:[^\"\\]|\\[\s\S])*\")"
_BRACE = rf"\{{(?:{_BRACE0}|\{{{_BRACE0}*\}})*\}}"
_DOUBLE = rf"\"(?:[^\"\\$`]|\\[\s\S]|\${_SUB2}|\$\{{(?:[^{{}}\"]|\{{[^{{}}]*\}}|\"[^\"]*\")*\}}|\$(?![({{])|`(?:[^`\\]|\\[\s\S])*`)*\""
_PART = rf"(?:[^\s'\"`\\$;&|<>()#]|(?<=[^\s;&|()<>])#|\\[\s\S]|\$?{_QUOTES}|\$?{_DOUBLE}|\${_SUB2}|\${_BRACE}|`(?:[^`\\]|\\[\s\S])*`|\$(?![({{])|[@?*+!](?={_SUB1})(?:[@?*+!]{_SUB1}))"


class Bash(Language):
    """Bash; here-documents are cut out before the tokens are made, command substitutions are words."""

    token = re.compile(
        rf"\\\r?\n|\#[^\n]*|[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=(?:\((?:[^()'\"\\]|\\[\s\S]|{_QUOTES}|{_DOUBLE}|{_SUB1})*\)|{_PART}*)|\(\((?:[^()]|\([^()]*\))*\)\)|"
        rf"\[\[(?=\s)(?:[^\]'\"\n\\]|\\[\s\S]|\](?!\])|{_QUOTES}|{_DOUBLE})*\s\]\](?=[\s;&|)]|$)|"
        rf"\d+(?=[<>])|<<<|&>>|&&|\|\||;;&|;;|;&|\|&|<<-?|>>|>\||<>|>&|<&|&>|[<>]{_SUB2}|{_PART}+|[^ \t\r]"
    )
    grammar = Grammar(
        """
        start = nls [ list ]
        nls = { 'n' }
        list = andor { ( ';' | '&' | 'n' ) nls andor } [ ( ';' | '&' | 'n' ) nls ]
        andor = pipeline { ANDOR nls pipeline }
        pipeline = { '!' | 'time' } command { PIPE nls command }
        command = simple | compound { redirect } | WORD '(' ')' nls compound { redirect } | 'function' ANY [ '(' ')' ] nls compound { redirect } | 'coproc' ( simple | compound )
        simple = { 'A' | redirect } ( 'A' | redirect | WORD { redirect | ANY } )
        redirect = [ 'd' ] REDIRECT ANY
        compound = '{' nls list '}' | '(' nls list ')' | 'e' | 'c' | if | ( 'while' | 'until' ) nls list 'do' nls list 'done' | for | case
        if = 'if' nls list 'then' nls list { 'elif' nls list 'then' nls list } [ 'else' nls list ] 'fi'
        for = ( 'for' | 'select' ) ( WORD | 'in' ) ( [ ';' ] nls | nls 'in' { ANY } ( ';' | 'n' ) nls ) group | 'for' 'e' [ ';' ] nls group
        group = 'do' nls list 'done' | '{' nls list '}'
        case = 'case' ANY nls 'in' nls { item } [ last ] 'esac'
        item = pattern ')' nls [ list ] BREAK nls
        last = pattern ')' nls [ list ]
        pattern = [ '(' ] ANY { '|' ANY }
        """,
        _SH,
        {
            "WORD": "w]",
            "ANY": "wA!{}]d" + "".join(_SH[x] for x in _SH_WORDS),
            "ANDOR": _SH["&&"] + _SH["||"],
            "PIPE": "|" + _SH["|&"],
            "REDIRECT": "<>" + "".join(_SH[x] for x in ">> <<< >| <> >& <& &> &>> <<".split()),
            "BREAK": _SH[";;"],
        },
    )
    heredoc = re.compile(r"(?<![<\d(])<<(-?)[ \t]*(?:'([^'\n]+)'|\"([^\"\n]+)\"|\\?([\w.-]+))")

    def __init__(self):
        def other(text: str) -> str:
            first = text[0]
            if first == "#" or text[:2] in ("\\\n", "\\\r"):
                return "\n" * text.count("\n")
            lines = "\x02" * text.count("\n")
            if text.startswith("((") and text.endswith("))"):
                return "e" + lines
            if text.startswith("[[") and text.endswith("]]"):
                return "c" + lines
            if text.isdigit():
                return "d"
            if text in "'\"`$" or first in "'\"`" and len(text) == 1:
                return "?"
            if re.match(r"[A-Za-z_]\w*(\[[^\]\n]*\])?\+?=", text):
                return "A" + lines
            return "w" + lines

        fixed = {k: v for k, v in _SH.items()} | {"\n": "n\n", "!": "!", ";&": _SH[";;"], ";;&": _SH[";;"], "<<-": _SH["<<"], "{": "{", "}": "}", "]": "]"} | {c: c for c in "();&|<>"}
        fixed.pop("((", None), fixed.pop("[[", None), fixed.pop("]]", None)
        self.classes = Classes(fixed, other)

    def without_documents(self, text: str) -> str:
        """``text`` with the lines of here-documents emptied."""
        if "<<" not in text:
            return text
        out, waiting = [], []
        for line in text.split("\n"):
            if waiting:
                dash, end = waiting[0]
                if (line.lstrip("\t") if dash else line).rstrip("\r") == end:
                    waiting.pop(0)
                out.append("")
                continue
            out.append(line)
            if "<<" in line and not line.lstrip().startswith("#"):
                waiting += [(m[1], m[2] or m[3] or m[4]) for m in self.heredoc.finditer(line)]
        return "\n".join(out)

    def parse(self, text: str) -> Verdict:
        grammar, empty = self.grammar, self.grammar.empty
        state, number, joined = grammar.fresh(), 0, self.without_documents(text)
        # a number is a descriptor only right before a redirection; the token pattern reads it apart there
        for word in self.words(joined):
            number += 1
            if "\x02" in word:
                number += word.count("\x02")
                word = word.replace("\x02", "")
            word = re.sub("d(?![<>" + "".join(_SH[x] for x in ">> <<< >| <> >& <& <<".split()) + "])", "w", word) if "d" in word else word
            after = state.words.get(word)
            if after is None:
                after = grammar.word(state, word)
            if after is empty:
                return Verdict(False, number)
            state = after
        return Verdict(True) if state.nullable else Verdict(False, None, True)


# --------------------------------------------------------------------------------------------------------------- YAML

_YAML_KEY = re.compile(
    r"""(?x) (?: (?:[&!][^\s,\[\]{}]*[ ]+)* ) (?: "(?:[^"\\\n]|\\.)*" | '(?:[^'\n]|'')*' | \*[^\s,\[\]{}]+[ ] | (?![\-?:][ ]) (?:[^\s\-?:,\[\]{}#&*!|>'"%@`] | [\-?:](?=\S)) (?:[^:#\n] | :(?=[^\s]) | (?<=\S)\# )*? ) [ ]* : (?=\s|$)"""
)
_YAML_FLOW = re.compile(r""""(?:[^"\\]|\\[\s\S])*"|'(?:[^']|'')*'|\#[^\n]*|[{}\[\],]|:(?=[\s,\[\]{}"']|$)|[^\s{}\[\],:"'#][^{}\[\],:\n]*(?::(?=[^\s,{}\[\]])[^{}\[\],:\n]*)*|\S""")


class Yaml(Language):
    """YAML: lines give the tokens key, dash, value, and the columns that open and close collections."""

    grammar = Grammar(
        """
        start = { 'D' } [ node ] { 'D' { 'D' } [ node ] }
        node = 'V' | block
        block = '(' ( map | seq ) ')'
        map = entry { entry }
        entry = 'K' [ node ]
        seq = dash { dash }
        dash = '-' [ node ]
        """,
        {},
        {},
    )
    flow = Grammar(
        """
        start = value
        value = 's' | 'w' | '[' [ item { ',' item } [ ',' ] ] ']' | '{' [ pair { ',' pair } [ ',' ] ] '}'
        item = value [ ':' [ value ] ]
        pair = ( 's' | 'w' | '[' [ item { ',' item } [ ',' ] ] ']' | '{' [ pair { ',' pair } [ ',' ] ] '}' ) [ ':' [ value ] ]
        """,
        {},
        {},
    )

    def parse(self, text: str) -> Verdict:
        if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f￾￿]", text):
            return Verdict(False, text.count("\n", 0, re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f￾￿]", text).start()) + 1)
        tokens, lines, broken = self.tokens(text.lstrip("﻿"))
        state, at = run(self.grammar, tokens)
        if at is not None:
            return Verdict(False, lines[at])
        if broken is not None:
            return Verdict(False, broken, broken >= text.count("\n"))
        return Verdict(True) if state.nullable else Verdict(False, None, True)

    def _flow(self, lines: list[str], at: int, column: int, indent: int) -> tuple[int, str] | None:
        """The line where a flow collection that begins at (at, column) ends and what follows it there; None if it is not well formed."""
        state, empty, depth = self.flow.start, self.flow.empty, 0
        rest, n = lines[at][column:], at
        while True:
            if n > at and (re.match(r"(---|\.\.\.)(\s|$)", rest) or rest.strip() and len(rest) - len(rest.lstrip(" ")) <= indent and indent >= 0 and rest.strip()[0] not in "]}"):
                return None
            pos = 0
            while (m := _YAML_FLOW.search(rest, pos)) is not None:
                word = m[0]
                pos = m.end()
                if word[0] == "#" and (m.start() == 0 or rest[m.start() - 1].isspace()):
                    break
                if word[0] in "\"'":
                    if len(word) < 2:  # a quoted word over several lines
                        n2 = n + 1
                        if n2 >= len(lines):
                            return None
                        rest, pos = rest[m.start() :] + "\n" + lines[n2], 0
                        n = n2
                        continue
                    token = "s"
                elif word in "{}[],:":
                    token = word
                    depth += (word in "{[") - (word in "}]")
                elif word[0] in "@`%" or word[0] == "-" and word.strip() == "-":
                    return None
                else:
                    token = "w"
                state = state[token]
                if state is empty:
                    return None
                if depth == 0:
                    return (n, rest[pos:]) if state.nullable else None
            n += 1
            if n >= len(lines):
                return None
            rest = lines[n]

    def tokens(self, text: str) -> tuple[list[str], list[int], int | None]:
        """Tokens, the line of each, and the line where no token can be made, if there is one."""
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        out: list[str] = []
        at_line: list[int] = []
        stack: list[tuple[int, str]] = []
        plain_open = False  # whether the last token is a plain scalar that further lines may continue
        n = 0

        def emit(token: str) -> None:
            out.append(token)
            at_line.append(n + 1)

        def place(column: int, kind: str) -> None:
            """Close and open collections for an entry at ``column``."""
            while stack and (stack[-1][0] > column or stack[-1][0] == column and stack[-1][1] == "-" and kind == "K"):
                stack.pop()
                emit(")")
            if not stack or stack[-1][0] < column or stack[-1][1] == "K" and kind == "-":
                stack.append((column, kind))
                emit("(")

        while n < len(lines):
            line = lines[n]
            body = line.strip(" \t")
            if not body or body[0] == "#":
                if plain_open and body[:1] == "#":
                    plain_open = False
                n += 1
                continue
            if re.match(r"(---|\.\.\.)(\s|$)", line):
                while stack:
                    stack.pop()
                    emit(")")
                emit("D")
                plain_open = False
                line = "   " + line[3:] if line.startswith("---") else line[3:]
                if not line.strip() or line.strip()[0] == "#":
                    n += 1
                    continue
            elif line[0] == "%" and (not out or out[-1] == "D"):
                n += 1
                continue
            column = len(line) - len(line.lstrip(" "))
            top = stack[-1][0] if stack else -1
            if plain_open and column > top:
                if _YAML_KEY.match(line, column):
                    return out, at_line, n + 1
                if re.search(r":(\s|$)", re.sub(r"\s#.*$", "", line)):
                    return out, at_line, n + 1
                n += 1
                continue
            if line[column] == "\t":
                rest = line.lstrip(" \t")
                if rest and rest[0] not in "#{}[]":
                    return out, at_line, n + 1
            plain_open = False
            first = True
            while True:  # the dashes and the key a line begins with
                if re.match(r"[-?](\s|$)", line[column:]):
                    place(column, "-")
                    emit("-")
                    after = column + 1
                elif key := _YAML_KEY.match(line, column):
                    place(column, "K")
                    emit("K")
                    after = key.end()
                else:
                    if first and out and out[-1] != "D":  # a value on a line of its own belongs to the key or dash above and is further in
                        while stack and stack[-1][0] >= column and out[-1] not in ("K", "-"):
                            stack.pop()
                            emit(")")
                        if out[-1] not in ("K", "-") or (stack and column <= stack[-1][0]):
                            return out, at_line, n + 1
                    after = column
                was_dash = out and out[-1] == "-" and after > column
                was_key = out and out[-1] == "K" and after > column
                first = False
                if after == column:
                    break
                gap = len(line[after:]) - len(line[after:].lstrip(" \t"))
                column = after + gap
                if was_dash and column < len(line) and line[column] != "#":
                    if "\t" in line[after:column] and (re.match(r"[-?](\s|$)", line[column:]) or _YAML_KEY.match(line, column)):
                        return out, at_line, n + 1
                    continue
                if was_key or column >= len(line) or line[column] == "#":
                    break
            value = line[column:]
            if not value.strip() or value[0] == "#":
                n += 1
                continue
            indent = stack[-1][0] if stack else -1
            value, shift = self._properties(value)
            column += shift
            if not value or value[0] == "#":
                if out[-1:] not in (["K"], ["-"]) and stack == []:
                    pass
                n += 1
                continue
            emit("V")
            if value[0] in "|>":
                m = re.match(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)(?:[ \t]+#.*|[ \t]*)$", value)
                if not m:
                    return out, at_line, n + 1
                n += 1
                lead = 0
                while n < len(lines) and (not lines[n].strip(" ") or len(lines[n]) - len(lines[n].lstrip(" ")) > indent):
                    lead += 1
                    n += 1
                continue
            if value[0] in "{[":
                end = self._flow(lines if value == lines[n][column:] else [*lines[:n], " " * column + value, *lines[n + 1 :]], n, column, indent)
                if end is None:
                    return out, at_line, n + 1
                n, rest = end
                if rest.strip() and not re.match(r"\s+#|\s*$", rest):
                    return out, at_line, n + 1
                n += 1
                continue
            if value[0] in "\"'":
                pattern = re.compile(r'"(?:[^"\\]|\\[\s\S])*"' if value[0] == '"' else r"'(?:[^']|'')*'")
                rest, m = value, pattern.match(value)
                while m is None:
                    n += 1
                    if n >= len(lines) or re.match(r"(---|\.\.\.)(\s|$)", lines[n]) or lines[n].strip() and len(lines[n]) - len(lines[n].lstrip(" ")) <= indent:
                        return out, at_line, n + 1
                    rest += "\n" + lines[n]
                    m = pattern.match(rest) if value[0] in lines[n] else None
                if value[0] == '"' and re.search(r'(?<!\\)(?:\\\\)*\\[^0abt\tnvfre "/\\N_LPxuU\n]', m[0]):
                    return out, at_line, n + 1
                if not re.match(r"\s*$|\s+#", rest[m.end() :]):
                    return out, at_line, n + 1
                n += 1
                continue
            if value[0] == "*":
                if not re.match(r"\*[^\s,\[\]{}]+\s*(#.*)?$", value):
                    return out, at_line, n + 1
                n += 1
                continue
            if value[0] in "@`%&!,]}" or re.match(r"[?:-](\s|$)", value):
                return out, at_line, n + 1
            bare = re.split(r"\s#", value)[0]
            if re.search(r":(\s|$)", bare):
                return out, at_line, n + 1
            plain_open = bare == value
            n += 1
        while stack:
            stack.pop()
            emit(")")
        return out, at_line, None

    @staticmethod
    def _properties(value: str) -> tuple[str, int]:
        """``value`` without anchors and tags before it, and how far it moved."""
        shift = 0
        while m := re.match(r"(?:&[^\s,\[\]{}]+|![^\s,\[\]{}]*)(\s+|$)", value):
            value, shift = value[m.end() :], shift + m.end()
        return value, shift


LANGS = {"js": JavaScript, "mjs": JavaScript, "ts": TypeScript, "sh": Bash, "yml": Yaml, "yaml": Yaml}
