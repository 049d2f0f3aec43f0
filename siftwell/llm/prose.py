"""Natural language hidden inside code (problem 2).

Comments (consecutive lines joined), docstrings and string literals (escapes read, adjacent pieces joined)
are taken out of each file and split into sentences. A sentence is encoded with one zstandard dictionary
per language and one for code; the shortest encoding of all names the language, and the span is rejected unless
it beats the code dictionary and the next language by a margin.

The dictionaries are built from labelled documents: at most ``DOCS_PER_LANGUAGE`` documents a language (of at
most ``DOC_CHARS`` characters, chosen by a hash of doc_id) and a short text of our own a language. Labels are
dirty, so sentences of the sample that another language's dictionary encodes shorter are left out and
the dictionaries built again. Classification reads every span of every file, whole.

Defined results: null and empty content has no prose; suffixes other than those of ``SUFFIXES`` have no rows;
identifiers, queries, paths, URLs, tags and bare copyright or licence lines are no sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.files import map_files, suffix_of

SUFFIXES = ("py", "go", "js", "ts", "java", "rs")
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "pl", "ru", "zh", "ja")
MIN_WORDS = 5
MIN_CJK = 8
DOCS_PER_LANGUAGE = 200
DOC_CHARS = 20_000
DICTIONARY_BYTES = 24_000
#: Bytes by which a language in Latin script must beat the code dictionary.
MARGIN = 2
#: Bytes by which it must beat the next language: sentences of languages without a dictionary lie between two.
RUNNER_UP = 2

SEED = {
    "en": "This is the text that we want to read. It should not be used when there is nothing left to do. The function returns the value if the user has asked for it, and raises an error otherwise. Please make sure that you have closed the file before you call this method. These options are only needed for older versions. We keep a copy of the data because it may be changed by another process. If you do not know what to do here, ask someone who does. Returns the number of items in the list. Waits until all of the tasks have finished their work.",
    "de": "Das ist der Text, den wir lesen wollen. Er soll nicht verwendet werden, wenn nichts mehr zu tun ist. Die Funktion gibt den Wert zurück, falls der Benutzer danach gefragt hat, und löst sonst einen Fehler aus. Bitte stelle sicher, dass die Datei geschlossen wurde, bevor du diese Methode aufrufst. Diese Optionen werden nur für ältere Versionen benötigt. Wir behalten eine Kopie der Daten, weil sie von einem anderen Prozess geändert werden können. Hier wird gewartet, bis alle Aufgaben ihre Arbeit beendet haben.",
    "fr": "C'est le texte que nous voulons lire. Il ne doit pas être utilisé quand il n'y a plus rien à faire. La fonction renvoie la valeur si l'utilisateur l'a demandée, et lève une erreur dans le cas contraire. Veuillez vous assurer que le fichier est fermé avant d'appeler cette méthode. Ces options ne sont nécessaires que pour les anciennes versions. Nous gardons une copie des données parce qu'elles peuvent être modifiées par un autre processus. On attend ici que toutes les tâches aient fini leur travail.",
    "es": "Este es el texto que queremos leer. No se debe usar cuando ya no queda nada que hacer. La función devuelve el valor si el usuario lo ha pedido, y lanza un error en caso contrario. Asegúrese de que el archivo está cerrado antes de llamar a este método. Estas opciones solo son necesarias para las versiones antiguas. Guardamos una copia de los datos porque otro proceso puede cambiarlos. Aquí se espera hasta que todas las tareas hayan terminado su trabajo.",
    "pt": "Este é o texto que queremos ler. Não deve ser usado quando não há mais nada a fazer. A função devolve o valor se o usuário o pediu, e lança um erro caso contrário. Certifique-se de que o arquivo está fechado antes de chamar este método. Estas opções só são necessárias para as versões antigas. Guardamos uma cópia dos dados porque eles podem ser alterados por outro processo. Aqui se espera até que todas as tarefas tenham terminado o seu trabalho.",
    "it": "Questo è il testo che vogliamo leggere. Non deve essere usato quando non c'è più niente da fare. La funzione restituisce il valore se l'utente lo ha chiesto, altrimenti solleva un errore. Assicurarsi che il file sia chiuso prima di chiamare questo metodo. Queste opzioni sono necessarie solo per le versioni più vecchie. Teniamo una copia dei dati perché possono essere cambiati da un altro processo. Qui si aspetta che tutti i compiti abbiano finito il loro lavoro.",
    "pl": "To jest tekst, który chcemy przeczytać. Nie należy go używać, gdy nie ma już nic do zrobienia. Funkcja zwraca wartość, jeśli użytkownik o nią poprosił, a w przeciwnym razie zgłasza błąd. Upewnij się, że plik jest zamknięty przed wywołaniem tej metody. Te opcje są potrzebne tylko dla starszych wersji. Przechowujemy kopię danych, ponieważ mogą zostać zmienione przez inny proces. Tutaj czekamy, aż wszystkie zadania zakończą swoją pracę.",
    "ru": "Это текст, который мы хотим прочитать. Его не следует использовать, когда больше нечего делать. Функция возвращает значение, если пользователь его запросил, а иначе вызывает ошибку. Убедитесь, что файл закрыт, прежде чем вызывать этот метод. Эти параметры нужны только для старых версий. Мы храним копию данных, потому что их может изменить другой процесс. Здесь мы ждём, пока все задачи не закончат свою работу.",
    "zh": "这是我们想要读取的文本。当没有任何事情可做的时候，不应该使用它。如果用户请求了这个值，函数就返回它，否则会抛出一个错误。请确保在调用这个方法之前文件已经关闭。这些选项只有旧版本才需要。我们保留一份数据的副本，因为另一个进程可能会修改它们。这里会一直等到所有任务都完成了工作。",
    "ja": "これは私たちが読みたいテキストです。何もすることがないときは使わないでください。ユーザーが値を求めた場合、関数はその値を返し、そうでない場合はエラーになります。このメソッドを呼び出す前に、ファイルが閉じていることを確認してください。これらのオプションは古いバージョンでのみ必要です。別のプロセスが変更する可能性があるため、データのコピーを保存しています。ここではすべてのタスクが終わるまで待ちます。",
}
CODE_SEED = """return cache.get(key) or 0
if value is None: return default
self.items.append(item) for item in range(10)
x = compute(a, b) + 1; y = x * 2
SELECT id, name FROM users WHERE state = 'open' ORDER BY id DESC LIMIT 100
UPDATE accounts SET total = total + 1 WHERE id = ?
INSERT INTO events (id, kind, value) VALUES (?, ?, ?)
DELETE FROM sessions WHERE expires < now() AND user_id = %s
SELECT count(*) AS n FROM a JOIN b ON a.id = b.a_id GROUP BY a.kind HAVING count(*) > 1
CREATE TABLE IF NOT EXISTS log (id INTEGER PRIMARY KEY, text TEXT NOT NULL)
const result = await fetch(url, { method: 'POST', headers: { 'Content-Type': 'application/json' } });
for (let i = 0; i < items.length; i++) { total += items[i].price; }
func main() { fmt.Println("ok") } if err != nil { return nil, err }
public static void main(String[] args) { System.out.println(x); }
pub fn new(value: &str) -> Self { Self { value: value.to_string() } } let mut v = Vec::new();
import os, sys, json, logging; from typing import Any, Optional def __init__(self, name=None):
try: open(path) except OSError as e: raise ValueError(str(e)) finally: f.close()
https://www.example.org/path/to/file.html /usr/local/bin/env /var/lib/app/data.db C:\\Users\\name\\file.txt
application/json text/html; charset=utf-8 Content-Type Accept-Encoding gzip deflate Authorization Bearer
usage: prog [-h] [--verbose] [--output FILE] input key=value name=test id=1 debug=true
%Y-%m-%dT%H:%M:%S ^[a-z]{2,8}-(foo|bar)$ \\d+\\s*[,;] #!/usr/bin/env python3 -*- coding: utf-8 -*-
TODO FIXME XXX NOTE noqa pylint: disable=too-many-arguments eslint-disable-next-line no-console nolint @param @return @throws
"""

_TRIPLE = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\''
_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\''
_HASH = re.compile(rf'(?P<t>[rRbBuUfF]{{0,2}}(?:{_TRIPLE}))|(?P<s>[rRbBuUfF]{{0,2}}(?:{_STRING}))|(?P<b>^[ \t]*/\*[\s\S]*?\*/)|(?P<c>\#[^\n]*|^[ \t]*//[^\n]*)', re.M)
_SLASH = re.compile(
    r"(?P<b>/\*[\s\S]*?\*/)|(?P<c>//[^\n]*|^[ \t]*\#+!?[ \t][^\n]*)"
    rf"|(?P<t>{_TRIPLE}|`(?:[^`\\]|\\[\s\S])*`|r(?P<h>\#+)\"[\s\S]*?\"(?P=h))|(?P<x>'(?:[^'\\\n]|\\[^\n]{{1,8}})'|(?<=[=(,:;!&|?{{}}\[+]) ?/(?![*/ ])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*)|(?P<s>{_STRING})",
    re.M,
)
_GO = re.compile(r"(?P<b>/\*[\s\S]*?\*/)|(?P<c>//[^\n]*|^[ \t]*\#+!?[ \t][^\n]*)|(?P<t>`[^`]*`|\"\"\"[\s\S]*?\"\"\")|(?P<x>'(?:[^'\\\n]|\\[^\n]{1,8})')|(?P<s>\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\[^\n])*')", re.M)
_RUST = re.compile(r"(?P<b>/\*[\s\S]*?\*/)|(?P<c>//[^\n]*|^[ \t]*\#+[ \t][^\n]*)|(?P<t>r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|\"\"\"[\s\S]*?\"\"\")|(?P<x>'(?:[^'\\\n]|\\[^\n]{1,8})'|'[^\W\d]\w*(?!'))|(?P<s>\"(?:[^\"\\]|\\[\s\S])*\")", re.M)
SCANNERS = {"py": _HASH, "go": _GO, "rs": _RUST}
_JOINED = re.compile(r"[ \t]*(?:\+|\\)?[ \t]*\r?\n?[ \t]*\+?[ \t]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u+([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([0-7]{1,3})|\r?\n[ \t]*|(.))", re.S)
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " ", "v": " ", "a": " ", "0": " "}
_COMMENT_MARK = re.compile(r"^[ \t]*(?:/{2,}[/!]?|/\*+!?|\*+/|\*+(?=\s|$)|#+!?|--)[ \t]*|[ \t]*\*+/[ \t]*$")
_NOTICE = re.compile(r"^\W*(?:copyright\b|\(c\)|©|spdx-|licen[sc]ed? (?:under|:)|licen[sc]e:|all rights reserved|sourcemappingurl)|^[\w.\- ]{1,40} v?\d[\w.]* \||^\W*\w[\w.\- ]* v?\d+\.\d+[\w.]*$", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])|(?<=[.!?…])(?=[\u3040-\u30ff\u3400-\u9fff])|(?:\n\s*){2,}")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_TOKEN = re.compile(r"\S+")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u30fc々〆ヵヶ]")
_KANA = re.compile(r"[\u3040-\u30ff]")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
_ODD = re.compile(r"[_=<>{}\[\]|\\@$%^&*~#/;`]|\w\.\w|\w\(|[a-z][A-Z]|::|->")
_QUERY = re.compile(r"^\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH)\b.*\b(?:FROM|INTO|SET|TABLE|AS)\b", re.S)
_STATEMENT = re.compile(r"^\s*(?:return|if|for|while|import|from|def|let|const|var|raise|throw|assert|print|yield|await|else|elif|pub|fn|func|use|package)\b[^.!?。]*[=(\[{:;][^.!?。]*$|^\s*[\w.]+\s*[-+*/]?=\s*\S|^\s*[\w.]+\([^)]*\)\s*;?\s*$|[;{}]\s*$")


def unescape(text: str) -> str:
    """A literal's content as the program reads it."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        code = m.group(1) or m.group(2) or m.group(3) or m.group(4)
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
        if m.group(5):
            return _PLAIN_ESCAPES.get(m.group(5)) or chr(int(m.group(5), 8))
        c = m.group(6)
        return _PLAIN_ESCAPES.get(c, c) if c else ""

    return _ESCAPE.sub(one, text)


def spans(suffix: str, text: str) -> list[tuple[str, str]]:
    """(kind, prose) of the comments and literals of a file; consecutive line comments and joined literals are one."""
    out: list[tuple[str, str]] = []
    comment: list[str] = []
    literal: list[str] = []
    comment_end = literal_end = -1

    def flush_comment() -> None:
        if comment:
            out.append(("comment", "\n".join(comment)))
            comment.clear()

    def flush_literal() -> None:
        if literal:
            out.append(("literal", "".join(literal)))
            literal.clear()

    for m in SCANNERS.get(suffix, _SLASH).finditer(text):
        kind, found = m.lastgroup, m.group()
        if m.group("c") is not None:
            flush_literal()
            between = text[comment_end : m.start()] if comment else ""
            if comment and (between.count("\n") != 1 or between.strip()):
                flush_comment()
            comment.append(_COMMENT_MARK.sub("", found.strip("\r")))
            comment_end = m.end()
            continue
        flush_comment()
        if m.group("b") is not None:
            flush_literal()
            out.append(("comment", "\n".join(_COMMENT_MARK.sub("", _COMMENT_MARK.sub("", x.rstrip("\r"))) for x in found.split("\n"))))
        elif kind in ("t", "h", "s") or m.group("t") is not None or m.group("s") is not None:
            body, raw = found, False
            while body[:1] not in "\"'`":
                raw |= body[0] in "rR"
                body = body[1:]
                if body[:1] == "#":
                    body = body.strip("#")
            q = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
            body = body[q:-q]
            if literal and not _JOINED.fullmatch(text, literal_end, m.start()):
                flush_literal()
            if not raw and (suffix != "go" or found[0] != "`"):
                body = unescape(body)
            literal.append(body)
            literal_end = m.end()
        else:
            flush_literal()
    flush_comment()
    flush_literal()
    return out


def sentences(span: str) -> list[str]:
    """Running text of a span, one sentence each; lines that are notices, tags or rules separate."""
    kept = []
    for line in span.split("\n"):
        bare = line.strip()
        if _NOTICE.search(bare) or bare.startswith(("@", ":", ">>>", "$ ", "-----")) or not any(c.isalpha() for c in bare):
            kept.append("")
        else:
            kept.append(bare)
    out = []
    for piece in _SENTENCE_END.split("\n".join(kept)):
        flat = " ".join(piece.split())
        if flat:
            out.append(flat)
    return out


def is_running(sentence: str) -> bool:
    """Enough words, few of the marks of code."""
    cjk = len(_CJK.findall(sentence))
    if cjk >= MIN_CJK:
        return True
    if _QUERY.match(sentence) or _STATEMENT.search(sentence):
        return False
    tokens = _TOKEN.findall(re.sub(r"`[^`]*`", " ", sentence))
    plain = [t for t in tokens if not _ODD.search(t) and any(c.isalpha() for c in t)]
    words = sum(len(_WORD.findall(t)) for t in plain)
    return words >= MIN_WORDS and len(plain) >= 4 and len(plain) >= 0.6 * len(tokens)


class Identifier:
    """Compression with one dictionary per language, and one for code."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self._make()

    def _make(self) -> None:
        self.coders = {}
        for name, content in self.dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=6)
            params = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.coders[name] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        self.language = lru_cache(200_000)(self._language)

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries}

    def __setstate__(self, state: dict) -> None:
        self.dictionaries = state["dictionaries"]
        self._make()

    def size(self, name: str, raw: bytes) -> int:
        return len(self.coders[name].compress(raw))

    def _language(self, sentence: str) -> str | None:
        """The language of a running sentence, of all dictionaries that which encodes it shortest; None where code or, in Latin
        script, another language encodes it about as short."""
        latin = len(_CJK.findall(sentence)) < MIN_CJK and len(_CYRILLIC.findall(sentence)) <= 0.5 * sum(map(str.isalpha, sentence))
        raw = sentence.lower().encode("utf-8", "replace")
        (best, n), (second, _) = sorted((self.size(n, raw), -i) for i, n in enumerate(LANGUAGES))[:2]
        if second - best < (RUNNER_UP if latin else 0) or best + (MARGIN if latin else 0) > self.size("code", raw):
            return None
        return LANGUAGES[-n]


_FENCE = re.compile(r"```[\s\S]*?(?:```|\Z)")


def _dictionary(seed: str, parts: Iterable[str]) -> bytes:
    """Distinct sentences up to ``DICTIONARY_BYTES``, the seed last, where matches are cheapest."""
    kept, size = [], 0
    for p in dict.fromkeys(parts):
        raw = p.lower().encode("utf-8", "replace")
        if size + len(raw) > DICTIONARY_BYTES:
            break
        kept.append(raw)
        size += len(raw) + 1
    return b" ".join([*kept, seed.lower().encode()])


def train(labelled: Iterable[tuple[str, str]]) -> Identifier:
    """An identifier from (language, text); code in fences goes to the code dictionary."""
    texts: dict[str, dict[str, None]] = {n: {} for n in LANGUAGES}
    code: dict[str, None] = {}
    for lang, text in labelled:
        for fence in _FENCE.findall(text):
            for line in fence.split("\n")[1:-1]:
                line = line.strip()
                if line.startswith(("#", "//", "/*", "*")):
                    continue
                line = re.sub(r"\d+", "0", re.sub(rf"{_TRIPLE}|{_STRING}|`[^`]*`|[^\x00-\x7f]+|(?:#|//|\"\"\").*", '""', line))
                if re.search(r"[=(){}\[\];:]", line):
                    code[line] = None
        for s in sentences(_FENCE.sub("\n\n", text)):
            if is_running(s):
                texts[lang][re.sub(r"`[^`]*`|\d+", "", s)] = None
    code_dictionary = _dictionary(CODE_SEED, code)
    kept: dict[str, dict[str, None]] = {n: {} for n in LANGUAGES}
    for _ in range(2):  # first by our own texts alone, then by what those confirmed
        model = Identifier({**{n: _dictionary(SEED[n], kept[n]) for n in LANGUAGES}, "code": code_dictionary})
        for lang, parts in texts.items():
            confirmed = {}
            for s in parts:
                if s in kept[lang]:
                    confirmed[s] = None
                    continue
                raw = s.lower().encode("utf-8", "replace")
                if model.size(lang, raw) < min(model.size(n, raw) for n in LANGUAGES if n != lang):
                    confirmed[s] = None
            kept[lang] = confirmed
    return Identifier({**{n: _dictionary(SEED[n], kept[n]) for n in LANGUAGES}, "code": code_dictionary})


def labelled_sample(documents: DataFrame) -> DataFrame:
    """(lang, text): the bounded sample that the dictionaries are built from."""
    lang = F.lower(F.trim("lang"))
    rows = documents.select("doc_id", lang.alias("lang"), "text").filter(
        lang.isin(*LANGUAGES) & (F.length("text") <= DOC_CHARS)
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= DOCS_PER_LANGUAGE).select("lang", "text")


def trained(documents: DataFrame) -> Identifier:
    return train(sorted(tuple(r) for r in labelled_sample(documents).collect()))


class _Spans:
    def __init__(self, model):
        self.model = model

    def __call__(self, path: str, text: str) -> list[tuple]:
        found: dict[str, list] = {}
        total = 0
        for _, span in spans(suffix_of(path), text):
            for s in sentences(span):
                if is_running(s) and (lang := self.model.value.language(s)):
                    entry = found.setdefault(lang, [0, 0, []])
                    entry[0] += 1
                    entry[1] += len(s)
                    entry[2].append(s)
                    total += len(s)
        return [(lang, n, chars, chars / max(1, len(text)), parts) for lang, (n, chars, parts) in sorted(found.items())]


def file_prose(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(workspace_id, filepath, nl_lang, sentences, chars, share, prose): one row per language of each file;
    ``share`` is the part of the file's characters."""
    model = chunks.sparkSession.sparkContext.broadcast(trained(documents))
    return map_files(chunks, "nl_lang string,sentences bigint,chars bigint,share double,prose array<string>", _Spans(model), SUFFIXES)
