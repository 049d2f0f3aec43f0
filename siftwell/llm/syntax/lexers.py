"""Lexers: source text -> token kinds and their places.

A kind is a keyword or operator itself, or a class such as ``ID``, ``NUM``, ``STR``. ``CONFLICT`` is a merge
marker line and ``ERR`` a character that starts no token, such as the quote of a string that does not end.
"""

from __future__ import annotations

import re

# Reserved words and operators of each language, as its specification lists them.
GO_WORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let yield".split()
)
#: Words that are keywords in some places and names in all others.
JS_SOFT = frozenset("async await of from as get set static".split())
TS_SOFT = JS_SOFT | frozenset(
    "abstract accessor any asserts assert bigint boolean declare global implements infer interface is keyof module namespace never number object out override private protected public readonly require satisfies string symbol type undefined unique unknown using".split()
)
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
JAVA_SOFT = frozenset("record sealed permits yield var when module open requires exports opens uses provides to with transitive".split())
RUST_WORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split()
)
RUST_SOFT = frozenset("union auto default macro_rules raw safe gen".split())
PY_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)

_CONFLICT = r"(?P<CONFLICT>^(?:<{7}|>{7}|\|{7}|={7})(?=[ \r\n]|\Z)[^\n]*)"
_C_SPACE = r"(?:[ \t\r\n\f\v\ufeff\xa0\u2028\u2029]+|//[^\n]*|/\*[\s\S]*?\*/)*"
_GO_ESC = r"\\(?:[abfnrtv\\%s]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[0-7]{3})"
_NUM = r"(?P<NUM>0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?\w*|0[bBoO][\d_]+\w*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?%s)"


def _ops(*ops: str) -> str:
    return "(?P<OP>" + "|".join(re.escape(x) for x in sorted(ops, key=len, reverse=True)) + ")"


def _master(space: str, *parts: str) -> re.Pattern:
    return re.compile(f"({space}+)(?:{'|'.join((_CONFLICT, *parts))}|(?P<EOF>\\Z)|(?P<ERR>[\\s\\S]))", re.M)


_GO = _master(
    _C_SPACE,
    r"(?P<W>[^\W\d]\w*)",
    _NUM % "i?",
    rf'(?P<STR>"(?:[^"\\\n]|{_GO_ESC % chr(34)})*"|`[^`]*`)',
    rf"(?P<CHAR>'(?:[^'\\\n]|{_GO_ESC % chr(39)})')",
    _ops(*"&^= <<= >>= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~".split()),
)
_GO_ENDS = frozenset("ID NUM STR CHAR ) ] } return break continue fallthrough ++ --".split())


def lex_go(text: str) -> tuple[list[str], list[int]]:
    kinds, places, last = [], [], ""
    for m in _GO.finditer(text):
        space, kind = m.group(1), m.lastgroup
        if kind == "EOF":
            break
        if space and last in _GO_ENDS and "\n" in space:
            kinds.append(";")
            places.append(m.start())
        if kind == "W":
            word = m.group("W")
            kind = word if word in GO_WORDS else "ID"
        elif kind == "OP":
            kind = m.group("OP")
        kinds.append(kind)
        places.append(m.start() + len(space))
        last = kind
    if last in _GO_ENDS:
        kinds.append(";")
        places.append(len(text))
    return kinds, places


_ID = r"(?P<W>[^\W\d]\w*)"
_JS_ID = r"(?P<W>(?:[^\W\d]|\$|\\u[\da-fA-F]{4})(?:\w|\$|\u200c|\u200d)*)"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*"
_AFTER = (
    r"(?:=>|[=!]==?|[<>]=|&&|\|\||\?\?=?|\*\*|[-+*%&|^]=|(?<!\+)\+(?!\+)|(?<!-)-(?!-)|[*%&|^<>!~?:=(,;{\[]|"
    r"\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|instanceof)\b)"
)
_JS_PARTS = (
    rf"(?P<OPREGEX>{_AFTER}[ \t\r\n]*+{_REGEX})",
    rf"(?P<REGEX>(?:(?<![\s\S])|(?<=[;{{}}]\n)){_REGEX})",
    _JS_ID,
    _NUM % "n?",
    r"""(?P<STR>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')""",
    r"(?P<TPL>`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`)",
    r"(?P<HEAD>`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*\$\{)",
    r"(?P<PRIV>#[^\W\d]\w*)",
    _ops(*">>>= ... === !== **= <<= >>= &&= ||= ??= => == != <= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** + - * / % & | ^ < > = ! ~ ? : ( ) [ ] { } , ; . @".split()),
)
_JS = _master(_C_SPACE, *_JS_PARTS)
_JS_MORE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JS_OPSPLIT = re.compile(rf"({_AFTER})[ \t\r\n]*+/")
_JS_BREAKS = frozenset("return break continue throw".split())


def _lex_js(text: str, soft: frozenset[str]) -> tuple[list[str], list[int]]:
    kinds, places = [], []
    add, at = kinds.append, places.append
    pos = 0
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else len(text)
    stack: list[int] = []  # depths of braces inside templates
    depth, last = 0, ""
    match = _JS.match
    scan = iter(_JS.finditer(text, pos)) if "${" not in text else None
    while True:
        m = next(scan, None) if scan is not None else match(text, pos)
        if m is None or m.lastgroup == "EOF":
            break
        kind, pos = m.lastgroup, m.end()
        space = m.group(1)
        nl = bool(space) and "\n" in space
        start = m.start() + len(space)
        if kind == "W":
            word = m.group("W")
            kind = word if word in JS_WORDS or word in soft else "ID"
        elif kind == "OP":
            kind = m.group("OP")
            if scan is None and stack:
                if kind == "{":
                    depth += 1
                elif kind == "}":
                    if depth == stack[-1]:
                        more = _JS_MORE.match(text, pos)
                        if more is None:
                            add("ERR")
                            at(start)
                            break
                        pos = more.end()
                        if more.group(1) == "`":
                            stack.pop()
                            kind = "TPLEND"
                        else:
                            kind = "TPLMID"
                    else:
                        depth -= 1
            elif scan is None:
                depth += (kind == "{") - (kind == "}")
        elif kind == "OPREGEX":
            op = _JS_OPSPLIT.match(m.group(kind)).group(1)
            if op in "{(" and scan is None:
                depth += op == "{"
            if nl and last in _JS_BREAKS:
                add("ASI")
                at(start)
            add("\n" + op if nl else op)
            at(start)
            kind, nl, start = "REGEX", False, start + len(op)
        elif kind == "HEAD":
            stack.append(depth)
        if nl and kind not in ("CONFLICT", "ERR"):
            if last in _JS_BREAKS:
                add("ASI")
                at(start)
                last = ""
            add("\n" + kind)
        else:
            add(kind)
        at(start)
        last = kind
    if stack:
        add("ERR")
        at(len(text))
    return kinds, places


def lex_js(text: str) -> tuple[list[str], list[int]]:
    return _lex_js(text, JS_SOFT)


def lex_ts(text: str) -> tuple[list[str], list[int]]:
    return _lex_js(text, TS_SOFT)


_JAVA_ESC = r"\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9A-Fa-f]{4})"
_JAVA = _master(
    _C_SPACE,
    r"(?P<W>(?:[^\W\d]|\$)(?:\w|\$)*)",
    _NUM % "[lLfFdD]?",
    rf'(?P<STR>"""[ \t\f]*\r?\n(?:[^\\"]|{_JAVA_ESC}|\\\r?\n|"(?!""))*"""|"(?!"")(?:[^"\\\n]|{_JAVA_ESC})*"|""(?!"))',
    rf"(?P<CHAR>'(?:[^'\\\n]|{_JAVA_ESC})')",
    _ops(*"... -> :: ++ -- && || == != <= += -= *= /= &= |= ^= %= <<= << + - * / & | ^ % < > = ! ~ ? : ( ) [ ] { } , ; . @".split()),
)
_RUST_ESC = r"\\(?:[nrt0\\\"']|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f_]{1,8}\})"
_RUST_SPACE = r"(?:[ \t\r\n\f\v\ufeff]+|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/)*"
_RUST = _master(
    _RUST_SPACE,
    r"""(?P<STR>[bc]?r(?P<h>\#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\\r?\n|%s)*")""" % _RUST_ESC,
    rf"(?P<CHAR>b?'(?:[^'\\\n]|{_RUST_ESC})')",
    r"(?P<LIFE>'[^\W\d]\w*)",
    r"(?P<W>r\#[^\W\d]\w*|[^\W\d]\w*)",
    r"(?P<NUM>0[xob][\da-fA-F_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf]\w*)?)",
    _ops(*"... ..= .. :: -> => && || == != <= += -= *= /= %= ^= &= |= <<= << + - * / % ^ ! & | < > = @ . , ; : # $ ? ~ ( ) [ ] { }".split()),
)


def _plain(pattern: re.Pattern, words: frozenset[str], text: str) -> tuple[list[str], list[int]]:
    kinds, places = [], []
    for m in pattern.finditer(text):
        kind = m.lastgroup
        if kind == "W":
            word = m.group("W")
            kind = word if word in words else "ID"
        elif kind == "OP":
            kind = m.group("OP")
        elif kind == "EOF":
            break
        kinds.append(kind)
        places.append(m.start() + len(m.group(1)))
    return kinds, places


_JAVA_ALL, _RUST_ALL = JAVA_WORDS | JAVA_SOFT, RUST_WORDS | RUST_SOFT


def lex_java(text: str) -> tuple[list[str], list[int]]:
    return _plain(_JAVA, _JAVA_ALL, text)


_RUST_BANG = re.compile(r"#!(?!\s*\[)[^\n]*")


def lex_rust(text: str) -> tuple[list[str], list[int]]:
    if m := _RUST_BANG.match(text):
        text = " " * m.end() + text[m.end() :]
    return _plain(_RUST, _RUST_ALL, text)


_JSON = _master(
    r"[ \t\r\n]*",
    r'(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")',
    r"(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)",
    r"(?P<W>[A-Za-z_]\w*)",
    _ops(*"{ } [ ] , :".split()),
)
_JSON_WORDS = frozenset("true false null".split())


def lex_json(text: str) -> tuple[list[str], list[int]]:
    return _plain(_JSON, _JSON_WORDS, text)


_PY_STR = (
    r'(?P<STR>(?i:[rbuf]{0,2})(?:"""(?:[^\\]|\\[\s\S])*?"""|' + r"'''(?:[^\\]|\\[\s\S])*?'''"
    r"""|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|""(?!")|''(?!')))"""
)
_PY = _master(
    r"(?:[ \t\f\ufeff]+|\\\r?\n|\#[^\n]*)*",
    _PY_STR,
    r"(?P<NL>\r?\n|\r)",
    _ID,
    _NUM % "[jJ]?",
    _ops(*"**= //= >>= <<= ... -> := == != <= >= ** // >> << += -= *= /= %= &= |= ^= @= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()),
)


def lex_py(text: str) -> tuple[list[str], list[int]]:
    """With NEWLINE, INDENT and DEDENT; a dedent to no open level is ERR."""
    kinds, places = [], []
    levels, depth, fresh = [0], 0, True
    for m in _PY.finditer(text):
        kind, start = m.lastgroup, m.start() + len(m.group(1))
        if kind == "EOF":
            break
        if kind == "NL":
            if depth == 0 and not fresh:
                kinds.append("NEWLINE")
                places.append(start)
                fresh = True
            continue
        if fresh:
            line = text.rfind("\n", 0, start) + 1
            column = len(text[line:start].expandtabs(8)) if text[line:start].strip(" \t\f\ufeff") == "" else levels[-1]
            if column > levels[-1]:
                levels.append(column)
                kinds.append("INDENT")
                places.append(start)
            while column < levels[-1]:
                levels.pop()
                kinds.append("DEDENT")
                places.append(start)
                if column > levels[-1]:
                    kinds.append("ERR")
                    places.append(start)
                    levels.append(column)
            fresh = False
        if kind == "W":
            word = m.group("W")
            kind = word if word in PY_WORDS else "ID"
        elif kind == "OP":
            kind = m.group("OP")
            if kind in "([{":
                depth += 1
            elif kind in ")]}":
                depth = max(0, depth - 1)
        kinds.append(kind)
        places.append(start)
    if not fresh:
        kinds.append("NEWLINE")
        places.append(len(text))
    for _ in levels[1:]:
        kinds.append("DEDENT")
        places.append(len(text))
    return kinds, places
