"""Credentials embedded in source code (problem 3).

A keyword automaton picks the lines worth reading; on these, issuer-format expressions, logins in URLs
and headers, private keys, and values assigned to credential names are read; each value is then
checked (structure of the format, decoded base64, masks, placeholders, references). The path says
how to read a file: in code a value is a literal (which may go on over several literals), in
configuration it may stand bare, and lock files hold hashes under every name.

Besides assignments, values are read where a text states them: as the argument of a call named for a credential,
as ``user:value`` of a command line, and in comments behind the word for one ("password is ...").

Redaction puts one upper-case letter, one lower-case letter and ``0`` for those of a value, taken from the
value's own alphabet (a hexadecimal value stays one, other scripts keep theirs, escapes stay escapes), so length,
alphabet, quotes and separators stay, and the redacted text has no finding.

Checksums: tokens of the two issuers that append one (CRC-32 in base 62) are compared with it. One that holds makes
the value a credential whatever surrounds it; one that does not hold is no reason to leave a value out, as tokens
of older forms have none. ``validity`` says which of the two a finding rests on.

Defined results: files of every suffix are read, whole; null and empty content has no finding; a value
is reported once, at the line where it begins; a private key at its BEGIN line. A key is read to its END line, however
far away; without one, to the end of its key text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import unicodedata
import zlib
from bisect import bisect_left
from functools import cache, lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from siftwell.llm.files import map_files, suffix_of

# What credentials are called.
PASSWORD_WORDS = frozenset(
    "password passwd pass pwd pw passphrase passcode passwort kennwort contrasena contraseña clave senha haslo hasło parol parola пароль 密码 パスワード secret credential credentials userpass dbpass".split()
)
TOKEN_WORDS = frozenset("token key bearer jwt apikey authkey secretkey accesskey authtoken accesstoken pat".split())
KEY_QUALIFIERS = frozenset(
    "api secret signing sign encryption encrypt service access private auth master account storage client server deploy ssh tls ssl rsa jwt hmac session app application shared webhook bot id refresh user admin data crypto cipher aes license integration".split()
)
# The formats in which issuers write their tokens.
ISSUERS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[\w-]{20,}",
    r"xox[abeoprs]-[\w-]{10,}",
    r"[sr]k_live_[A-Za-z0-9]{16,}",
    r"AIza[\w-]{35}",
    r"SG\.[\w-]{16,}\.[\w-]{16,}",
    r"do[opr]_v1_[0-9a-f]{64}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[\w-]{40,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}",
    r"eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,}",
    r"sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}",
)
# How the formats above begin, words of headers and command lines, and words for a login.
PREFIXES = "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xox sk_live_ rk_live_ AIza SG. _v1_ npm_ pypi- hf_ shpat_ shpca_ shppa_ shpss_ eyJ sk- -----BEGIN ://".split()
HEADER_WORDS = "authorization bearer basic token apikey".split()
LOGIN_WORDS = "login log-in log_in credential user anmeldung acceso конто".split()
COMMAND_WORDS = ["-u ", "--user"]
#: Words for a credential whose keyword is shorter than they are: their stems.
STEMS = {"contrasena": "contrase", "contraseña": "contrase", "parola": "parol", "пароль": "парол", "credentials": "credential"}
CODE_SUFFIXES = frozenset("py go js ts jsx tsx mjs cjs java rs c h cc cpp cs kt scala rb php swift".split())
#: Calls whose argument is the value itself.
WRAPPERS = frozenset("concat! String::from String str bytes Buffer.from atob b64decode base64.b64decode SecretStr Secret []byte".split())
LOCK_SUFFIXES = frozenset("lock sum".split())
PLACEHOLDER = re.compile(
    r"(?i)^(?:change[-_ ]?me\w*|replace[-_ ]?me|fill[-_ ]?me\b.*|redacted|removed|hidden|masked|none|null|nil|undefined|true|false|todo|tbd|n/?a|dummy|fake|test|sample|example\w*|placeholder|password|passwd|secret|token|default|empty|unset|not[-_ ]?set|insert.*here|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|put[-_ ].*|enter[-_ ].*|foo|bar|baz|foobar|abc123|1234567*8*9*0*)$"
    r"|example|placeholder|changeme|your[-_](?:api|secret|token|key|password)|<[^<>]*>|\$\{|\$\(|\{\{|%\(|\[\[|<%|^%\w+%$|^\$[A-Za-z_]\w*$|^@@|^\{\w*\}$|^%s$|^#\{"
)
REFERENCE = re.compile(
    r"(?i)^(?:os\.|process\.|System\.|env[!.(\[]|getenv|ENV\[|viper\.|config\.|settings\.|secrets?[./:\[]|vault[:/]|arn:|file:|ref:|op://|ssm:|sm://|kms:|!\w|ENC\[|AQICA|\$2[abxy]?\$|\$argon2|\$[156]\$|\{S?SHA|pbkdf2|sha\d+[-:$]|md5[:$])"
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
_ISSUER = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(ISSUERS) + r")(?![A-Za-z0-9])")
_URL = re.compile(r"[a-z][a-z0-9+.\-]*://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+)@[\w.\-\[${%]", re.I)
_COMMAND = re.compile(r"(?<!\S)(?:-u|--user)[ =]+[\"']?([\w.@\-]+):([^\s\"'`]+)")
_STATED = re.compile(r"([^\W\d][\w\-]*)[\"'`]?\s+(?:(?:is|was|are|now|ist|war|lautet|est|était|es|era|é|foi|è|to|было|это|:|=|->)\s+)*[\"'`]?([^\s\"'`,;()<>{}\[\]]{6,})")
_SETTER = re.compile(r"([^\W\d]\w*)\(\s*(?=[\"'`rRbBuU@])")
_HEADER = re.compile(r"\b(Basic|Bearer|Token|ApiKey)[ ]+([A-Za-z0-9+/._~\-]{8,}={0,2})", re.I)
#: Text of a key: lines of base64, also as literals or with escaped line ends, and the headers of encrypted ones.
_KEY_TEXT = re.compile(
    r"(?:\\[nrt]|[A-Za-z0-9+/=]{16,}+|[\s\"'`+,;()*#\\|>]|(?:Proc-Type|DEK-Info)[^\n\\]*)*+(?:[A-Za-z0-9+/=]{1,15}(?=(?:\\[nrt]|[\s\"'`+,;)])*(?:-----END|\Z)))?"
)
_KEY_TOKEN = re.compile(r"\\.|(?:Proc-Type|DEK-Info)[^\n\\]*|[A-Za-z0-9+/=]+")
_BODY_END = re.compile(r"(?:\\[nrt]|[\s\"'`+,;)])*-----END")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY(?: BLOCK)?-----")
_LOGIN = re.compile(r"(?i)\b(?:log[-_ ]?in|credentials?|user(?:name)?|anmeldung|acceso|конто)\b\s*[:=]\s*[\w.@\-]+\s*[/|]\s*(\S+)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=])")
_TYPE = r"(?:\s*:\s*&?(?:'\w+\s+)?[A-Za-z_][\w.:]*(?:<[^<>=]*>|\[\])?(?:\s*\|\s*\w+)?\??\s*(?==))?"
_KEY = r"(?P<k>[^\W\d][\w.\-]*)(?P<q>[\"'`]?)\]?"
_SET = (
    r"\s*(?P<s>:=|=>|=(?![=>])|:(?![:=/])|,(?=\s*[\"'`]))[ \t]*"
    r"(?P<o>(?:new\s+)?(?:(?P<f>[\w.:!\[\]]*)\([ \t]*)?(?:\\?\r?\n\s*)?)"
)
#: Name and sign of assignment, in code with a type between them.
_PAIR, _PAIR_CODE = re.compile(_KEY + _SET), re.compile(_KEY + _TYPE + _SET)
#: A name and its value as two entries, one below the other.
_NAMED = re.compile(r"\bname[\"']?\s*[:=]\s*[\"']?([\w.\-]+)[\"']?,?[ \t]*\r?\n?[ \t\-]*[\"']?value[\"']?\s*[:=][ \t]*", re.I)
_LITERAL = re.compile(r'(?:[rRbBuUfF]{1,2}|@)?(?:"""([\s\S]*?)"""|\'\'\'([\s\S]*?)\'\'\'|"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`]*)`|r#"([\s\S]*?)"#)')
_JOIN = re.compile(r"\s*(?:\+|\.\.|\.(?=\s*[\"'])|\\\r?\n)?\s*(?=[\"'`])")
_BARE = re.compile(r"[^\s#;,][^\s;,]*")
_NAME = re.compile(r"[^\W\d][\w.\-]*")
_NAME_WORD = re.compile(r"\bname", re.I)
_COMMENT_TAIL = re.compile(r"(?:^|\s)(?:#|//|/\*|--|<!--)\s")
_COMMENT = re.compile(r"\s*(?:#|//|/?\*|--|;|<!--|rem\b)\s*", re.I)


def _aligned(needle: str) -> set[str]:
    """What ``needle`` looks like inside base64, at each of the three places it can begin."""
    out = set()
    for shift in range(3):
        code = base64.b64encode(b"\0" * shift + needle.encode()).decode().rstrip("=")
        whole = (shift + len(needle)) * 8 // 6  # signs that no later byte changes
        out.add(code[-(-shift * 8 // 6) : whole])
    return out


@cache
def keywords() -> tuple[str, ...]:
    """What a line must hold, in lower case, to be read: the names of credentials, the beginnings of formats, the words
    of headers, logins and command lines, and the formats' beginnings in base64."""
    words = {STEMS.get(w, w) for w in (*PASSWORD_WORDS, *TOKEN_WORDS, "mdp", "passe", "motdepasse")}
    words |= {x.lower() for x in (*PREFIXES, *HEADER_WORDS, *LOGIN_WORDS, *COMMAND_WORDS, "access")}
    words |= {x.lower() for p in PREFIXES for x in _aligned(p) if len(x) > 3 or p == "://"}
    return tuple(sorted(w for w in words if not any(v in w for v in words if v != w)))


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k in keywords():
        a.add_word(k, len(k))
    a.make_automaton()
    return a


@lru_cache(20_000)
def name_class(name: str) -> int:
    """2: the name of a password or secret, 1: of a key or token, 0: neither."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and (words[-1].isdigit() or (len(words) > 1 and words[-1] in ("value", "str", "string", "b64", "base64"))):
        words.pop()
    if not words:
        return 0
    last = words[-1]
    if last in PASSWORD_WORDS or words[-3:] == ["mot", "de", "passe"] or last in ("motdepasse", "mdp"):
        return 2
    if last in TOKEN_WORDS:
        if last in ("key", "token"):
            if "public" in words or "header" in words:
                return 0
            return 1 if len(words) > 1 and words[-2] in KEY_QUALIFIERS or last == "token" else 0
        return 1
    if len(words) > 2 and words[-3:] == ["access", "key", "id"]:
        return 1
    return 0


def _mixed(value: str) -> bool:
    """Whether a value has what tokens have: digits and letters, or upper and lower case, and some length."""
    digit = any(c.isdigit() for c in value)
    upper, lower = any(c.isupper() for c in value), any(c.islower() for c in value)
    return len(value) >= 8 and len(set(value)) > 4 and digit + upper + lower >= 2


def _decoded(value: str) -> str | None:
    """The printable text that base64 ``value`` stands for, if it does."""
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return text if text and all(c.isprintable() or c in "\r\n\t" for c in text) else None


def harmless(value: str) -> bool:
    """Empty, masked, a placeholder, or a reference to where the value is kept."""
    v = _CODED_X.sub("x", value.strip())
    if len(v) < 4 or not any(c.isalnum() and c not in "xX0" for c in v) or len(set(v.lower())) < 3 or len({c for c in v if c.isalnum()}) < 4 and _is_masked(v):
        return True
    if PLACEHOLDER.search(v) or REFERENCE.match(v):
        return True
    tail = v.split("_")[-1] if "_" in v[:8] else v[4:]
    return len(tail) >= 8 and len(set(tail)) < 3


def _is_masked(value: str) -> bool:
    """Whether every letter and digit is the placeholder of its kind."""
    return all(not c.isalnum() or c in "0xXaA" or c == _first_alike(c) for c in value)


#: What ``placeholder`` leaves of coded characters.
_CODED_X = re.compile(r"%78|\\(?:x78|u0078|U00000078|u\{0*78\}|170)")
_CRC = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")
# Fixed value: the digits of base 62 in the order of those checksums.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(value: str) -> bool:
    """Whether an issued token ends in the CRC-32 of what precedes it."""
    m = _CRC.fullmatch(value)
    if not m:
        return False
    n = 0
    for c in m.group(2):
        n = 62 * n + BASE62.index(c)
    return n == zlib.crc32(m.group(1).encode())


def is_issued(value: str) -> bool:
    """Whether an issuer-format match has the checksum or the structure of its format."""
    if checksum_holds(value):
        return True
    if harmless(value):
        return False
    if value.startswith("eyJ"):
        head = value.split(".", 1)[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (binascii.Error, ValueError):
            return False
    return len(set(value[4:])) > 5


def is_secret(value: str, kind: int) -> bool:
    """Whether ``value`` under a name of class ``kind`` is a live credential."""
    v = value.strip()
    if harmless(v):
        return False
    if "://" in v:
        return False  # read as a URL
    if m := _HEADER.search(v):
        return is_login_header(m.group(1), m.group(2))
    if v.startswith(("-----BEGIN", "data:")) or v.lower() in ("bearer", "basic"):
        return False  # read as a key
    plain = _decoded(v) if len(v) >= 8 and len(v) % 4 == 0 else None
    if plain and len(plain) > 3 and (harmless(plain) or "PUBLIC KEY" in plain or "CERTIFICATE" in plain):
        return False
    if re.fullmatch(r"[a-z]+(?:[_\-./ :][a-z]+)*/?", v) or re.fullmatch(r"[\d.,:\-]+", v) or " " in v and not any(c.isdigit() for c in v):
        return False  # words, names, paths and numbers
    if re.match(r"(?:[./~]|[A-Za-z]:\\|vault/|secret/)[\w./\\\-]*$", v) and v.count("/") > 1 and not _mixed(v.replace("/", "")):
        return False
    if re.fullmatch(r"[A-Za-z][A-Za-z\-]*", v) and "-" in v and v.lower().startswith("x-"):
        return False  # a header's name
    return _mixed(v) if kind == 1 else len(v) >= 5 and (any(c.isdigit() or c.isupper() for c in v) or not v.isalnum())


def is_login_header(scheme: str, value: str) -> bool:
    if harmless(value):
        return False
    if scheme.lower() == "basic":
        plain = _decoded(value)
        return bool(plain) and ":" in plain and not harmless(plain.split(":", 1)[1])
    return is_issued(value) if value.startswith("eyJ") else len(value) >= 16 and _mixed(value)


def _literal(text: str, at: int) -> tuple[str, list[tuple[int, int]]] | None:
    """The value of the literal at ``at``, with those joined to it, and the places of its pieces."""
    parts, spans = [], []
    while m := _LITERAL.match(text, at):
        group = m.lastindex
        parts.append(m.group(group))
        spans.append(m.span(group))
        go_on = _JOIN.match(text, m.end())
        if not go_on or go_on.end() == m.end():
            break
        at = go_on.end()
    return ("".join(parts), spans) if parts else None


def key_text(text: str, at: int) -> list[tuple[int, int]]:
    """Places of the key text of a private key whose BEGIN line ends at ``at``.

    It goes to the next END marker, unless another key begins before that; without one, as far as lines of a key do."""
    stop, other = text.find("-----END", at), text.find("-----BEGIN", at)
    run = _KEY_TEXT.match(text, at).end()
    if stop < 0 or 0 <= other < stop:
        stop = run
    out = []
    for m in _KEY_TOKEN.finditer(text, at, stop):
        if m.group()[0] == "\\" or ":" in m.group():
            continue
        if len(m.group()) >= 16 or m.end() <= run or _BODY_END.match(text, m.end()):
            out.append(m.span())
    return out


def _is_stated(value: str) -> bool:
    """Whether a word behind the name of a credential is one: letters and digits of mixed kinds, as no word has."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and is_secret(value, 1) and not re.fullmatch(r"[A-Za-z]+\d{1,2}|v?\d[\d.]*\w?|[a-z]+(?:[_.\-]\w+)+\(?\)?", value)


def find_credentials(path: str, text: str) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(place, kind, places of the pieces) of every credential of a file, in order."""
    suffix = suffix_of(path)
    if not text or suffix in LOCK_SUFFIXES or path.endswith(("package-lock.json", "npm-shrinkwrap.json")):
        names = False
    else:
        names = True
    code = suffix in CODE_SUFFIXES
    found: dict[int, tuple[str, list[tuple[int, int]]]] = {}
    taken: list[tuple[int, int]] = []  # apart from each other, in order

    def add(kind: str, spans: list[tuple[int, int]]) -> None:
        a, z = spans[0]
        i = bisect_left(taken, (a, a))
        if not (i and taken[i - 1][1] > a or i < len(taken) and taken[i][0] < z):
            found[a] = (kind, spans)
            for s in spans:
                taken.insert(bisect_left(taken, s), s)

    def assigned(a: int, z: int, line: str) -> None:
        comment = _COMMENT.match(line)
        bare = not code or comment is not None
        mark = _COMMENT_TAIL.search(line)
        if code and not mark and not comment and not any(q in line for q in "\"'`") and not line.rstrip().endswith(("=", "(", "\\")):
            return
        if m := _LOGIN.search(text, a, z):
            if is_secret(m.group(1), 1):
                add("login", [m.span(1)])
        if (start := a + len(line) - len(line.lstrip())) < z and text[start] in "\"'`" and (got := _literal(text, start)) and len(got[1]) > 1:
            if (x := _ISSUER.fullmatch(got[0])) and is_issued(x.group()):
                add("assigned secret", got[1])
        for x in _NAME_WORD.finditer(line) if not code else ():
            if not (m := _NAMED.match(text, a + x.start())) or not (kind := name_class(m.group(1))):
                continue
            got = _literal(text, m.end())
            if got and is_secret(got[0], kind):
                add("assigned secret", got[1])
            elif not got and (v := _BARE.match(text, m.end())) and is_secret(v.group(), kind) and not any(c in v.group() for c in "(){}[]<>"):
                add("assigned secret", [v.span()])
        at, pair = a, _PAIR_CODE if code else _PAIR
        for x in _NAME.finditer(text, a, z):
            if x.start() < at or not (m := pair.match(text, x.start())):
                continue
            at = m.end("k")
            name = m.group("k")
            kind = name_class(name)
            if m.group("s") == "," and not (kind and m.group("q")):
                continue
            if "\n" in m.group("o") and not code or m.group("f") and m.group("f") not in WRAPPERS:
                continue
            got = _literal(text, m.end())
            if got:
                value, spans = got
                if kind and is_secret(value, kind) or not kind and len(spans) > 1 and (x := _ISSUER.fullmatch(value)) and is_issued(x.group()):
                    add("assigned secret", spans)
                at = max(at, spans[-1][1])
            elif kind and bare and (v := _BARE.match(text, m.end())) and m.end() < z:
                value = v.group().rstrip("\"',}")
                rest = text[v.end() : z].strip()
                if comment and code and (rest or "(" in value or not _mixed(value)):
                    continue
                if not any(c in value for c in "(){}[]<>") and is_secret(value, kind):
                    add("assigned secret", [(v.start(), v.start() + len(value))])
        for m in _SETTER.finditer(text, a, z) if code else ():
            if (kind := name_class(m.group(1))) and (got := _literal(text, m.end())) and is_secret(got[0], kind):
                add("assigned secret", got[1])
        if comment or mark:
            for m in _STATED.finditer(text, a + (0 if comment else mark.end()), z):
                v = m.group(2).rstrip(".:!?")
                if name_class(m.group(1)) and _is_stated(v):
                    add("stated secret", [(m.start(2), m.start(2) + len(v))])

    done = 0
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for end, _ in _automaton().iter(low):
        if end < done:
            continue
        a = text.rfind("\n", 0, end) + 1
        z = text.find("\n", end)
        z = done = len(text) if z < 0 else z
        line = text[a:z]
        if "-----BEGIN" in line:
            for m in _PRIVATE.finditer(text, a, z):
                body = key_text(text, m.end())
                whole = "".join(text[x:y] for x, y in body)
                if len(whole) >= 24 and not harmless(whole):
                    add("private key", [m.span(), *body])
            if "PUBLIC" in line or "CERTIFICATE" in line:
                continue
        if names:
            assigned(a, z, line)
        for m in _ISSUER.finditer(text, a, z):
            if is_issued(m.group()):
                add("issued token", [m.span()])
        for m in _COMMAND.finditer(text, a, z):
            if is_secret(m.group(2), 2):
                add("login on a command line", [m.span(2)])
        if "://" in line:
            for m in _URL.finditer(text, a, z):
                if not harmless(m.group(2)) and not REFERENCE.match(m.group(2)):
                    add("login in URL", [m.span(2)])
        for m in _HEADER.finditer(text, a, z):
            if is_login_header(m.group(1), m.group(2)):
                add("login in header", [m.span(2)])
        if "=" in line or ":" in line:
            for m in _BASE64.finditer(text, a, z):
                plain = _decoded(m.group()) if len(m.group()) % 4 == 0 else None
                if plain and ((x := _ISSUER.search(plain)) and is_issued(x.group()) or (x := _URL.search(plain)) and not harmless(x.group(2)) or _PRIVATE.search(plain)):
                    add("encoded secret", [m.span()])
    return [(a, *found[a]) for a in sorted(found)]


_ESCAPES = re.compile(r"(\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|u\{[0-9A-Fa-f]+\}|[0-7]{3}|.))", re.S)
_URL_ESCAPES = re.compile(r"(%[0-9A-Fa-f]{2})")


@cache
def _first_alike(c: str) -> str:
    """The first character of the same kind in the block of 128 that ``c`` stands in, so of its script and length."""
    kind = unicodedata.category(c)
    return next(x for o in range(ord(c) & ~127, ord(c) + 1) if unicodedata.category(x := chr(o)) == kind)


def _placeholder_escape(part: str) -> str:
    """A coded character as the code of ``x``; escapes by one letter stay."""
    if part[0] == "%":
        return "%78"
    if len(part) == 4 and part[1].isdigit():
        return "\\170"
    if len(part) > 2:
        digits = [i for i in range(2, len(part)) if part[i] not in "{}"]
        return part[:2] + "".join("{}"["{}".index(c)] if c in "{}" else "78".rjust(len(digits), "0")[-len(digits) :][digits.index(i + 2)] for i, c in enumerate(part[2:]))
    return part


def placeholder(value: str, whole: str | None = None, url: bool = False) -> str:
    """Same length and alphabet; ``whole`` is the value that ``value`` is a piece of."""
    escapes = _URL_ESCAPES if url else _ESCAPES
    plain = escapes.sub("", whole or value)
    hexadecimal = not any(c.isascii() and c.isalpha() and c not in "abcdefABCDEF" for c in plain)
    upper, lower = ("A", "a") if hexadecimal else ("X", "x")
    one = lambda c: (upper if c.isupper() else lower if c.isalpha() else "0" if c.isdigit() else c) if c.isascii() else _first_alike(c) if c.isalnum() else c
    return "".join(_placeholder_escape(part) if n % 2 else "".join(map(one, part)) for n, part in enumerate(escapes.split(value)))


def redact(path: str, text: str) -> str:
    out, at = [], 0
    pieces = []
    for _, kind, spans in find_credentials(path, text):
        spans = spans[1:] if kind == "private key" else spans
        whole = "".join(text[a:z] for a, z in spans)
        pieces += [(a, z, whole, kind == "login in URL") for a, z in spans]
    for a, z, whole, url in sorted(pieces):
        if a >= at:
            out += [text[at:a], placeholder(text[a:z], whole, url)]
            at = z
    return "".join([*out, text[at:]])


def _find_rows(path: str, text: str) -> list[tuple]:
    rows, line, at = [], 1, 0
    for place, kind, spans in find_credentials(path, text):
        line += text.count("\n", at, place)
        at = place
        value = "".join(text[a:z] for a, z in spans)
        rows.append((line, kind, "checksum" if any(checksum_holds(x) for x in _ISSUER.findall(value)) else "structure"))
    return rows


def credential_places(chunks: DataFrame) -> DataFrame:
    """(workspace_id, filepath, line_no, kind, validity): one row per credential."""
    return map_files(chunks, "line_no bigint,kind string,validity string", _find_rows)


def redacted_files(chunks: DataFrame) -> DataFrame:
    """(workspace_id, filepath, credentials, redacted) of the files that hold credentials."""

    def rows(path: str, text: str) -> list[tuple]:
        n = len(find_credentials(path, text))
        return [(n, redact(path, text))] if n else []

    return map_files(chunks, "credentials int,redacted string", rows)
