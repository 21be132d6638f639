"""Secrets by assignment-aware lexing.

Source and configuration text is cut into tokens (identifiers, string literals,
bare words, operators) and parsed into name-literal pairs: `name = value`
and `name := value` of programming languages and shells, `name: value` of YAML,
`"name": "value"` of JSON, `name => value`, `#define NAME value`, `name="value"` of
XML, and arguments of calls and command lines. Constants are propagated: a value
may be a concatenation of literals and names, or hold `${name}` or `{name}`; a name
stands for what was last assigned to it. Names are those of the whole text, without
scopes. A literal is scored by how sensitive its target name is and by its own
look, and is a secret from THRESHOLD on.

A value that is put together from constants and is longer than LONGEST
characters is no secret, and neither is what is made of it; so a chain of
constants that double takes no more room than the text. A literal that stands in
the text as it is may have any length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, table

THRESHOLD = 0.6
#: A value put together from constants is a secret up to so many characters.
LONGEST = 8192
#: A literal whose own look scores less is a word, whatever its name.
LEAST_LOOK = 0.1
#: Sensitivity of the words of a name; a pair of words counts as one.
WORDS = {"password": 0.7, "passwd": 0.7, "passphrase": 0.7, "pwd": 0.65, "pass": 0.45, "secret": 0.6, "token": 0.5, "credential": 0.6, "credentials": 0.6, "auth": 0.35, "apikey": 0.65, "bearer": 0.5, "authorization": 0.5, "signature": 0.3, "salt": 0.35, "jwt": 0.5, "otp": 0.4, "privatekey": 0.65, "secretkey": 0.7, "accesskey": 0.6, "key": 0.25}
PAIRS = {("api", "key"): 0.65, ("api", "token"): 0.65, ("api", "secret"): 0.7, ("secret", "key"): 0.7, ("access", "key"): 0.6, ("private", "key"): 0.65, ("access", "token"): 0.6, ("auth", "token"): 0.6, ("refresh", "token"): 0.6, ("client", "secret"): 0.7, ("encryption", "key"): 0.6, ("signing", "key"): 0.6, ("master", "key"): 0.6, ("account", "key"): 0.5, ("connection", "string"): 0.5, ("db", "pass"): 0.65}
#: Words of a name that speak of something about a secret, not of the secret.
HARMLESS = frozenset("length len size min max count limit name file path url uri regex pattern type field label hint policy expiry expires expired ttl id public prompt format enabled required reset forgot index column table class header placeholder".split())
_PLACEHOLDER = re.compile(r"(?i)^(?:<[^>]*>|\$\{[^}]*\}|\$\w+|\{\{.*\}\}|%\(?\w+\)?s?|x+|\*+|\.+|-+|#+|_+|0+|none|null|nil|undefined|true|false|empty|changeme|change[_-]?me|your.*|my.*here|.*example.*|.*placeholder.*|todo|tbd|test|testing|dummy|fake|sample|redacted|secret|password|token|string|str|int|bool|optional|required|default)$")
_KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{36,}|xox[abprs]-[\w-]{10,}|sk[-_](?:live[-_])?\w{16,}|AIza[\w-]{35}|eyJ[\w-]+\.[\w-]+\.[\w-]*|-----BEGIN [A-Z ]*PRIVATE KEY-----.*)", re.S)
_TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+)|(?P<define>\#define\b)|(?P<newline>\n)
    |(?P<string>[rRbBuUfF]{0,2}(?:\"\"\"(?P<s3>.*?)\"\"\"|'''(?P<s4>.*?)'''|"(?P<s1>(?:\\.|[^"\\\n])*)"|'(?P<s2>(?:\\.|[^'\\\n])*)'|`(?P<s5>[^`\n]*)`))
    |(?P<name>--?[^\W\d][\w-]*(?=[=\s])|[^\W\d][\w$]*(?:(?:\.|::|->|-(?=[^\W\d]))[^\W\d][\w$]*)*)
    |(?P<number>\d[\w.]*)
    |(?P<op>:=|=>|==|!=|<=|>=|\+=|\?\?=|\?=|\|\|=|=|:|\+|\.\.?|&|[^\s\w])""",
    re.S | re.X,
)
_ASSIGN = frozenset((":=", "=>", "=", "?=", "??=", "||=", ":", "+="))
_BARE = re.compile(r"(?:\$\{[\w.]+\}|[^\s,;\"'`(){}\[\]<>])+")
#: Before the name of a pair that a line of .env, INI, YAML or HTTP headers holds, and the rest of the line up to a comment.
_LINE_HEAD = re.compile(r"[^\S\n]*(?:export\s+|set\s+|-\s+)?$", re.I)
_LINE_REST = re.compile(r"[^\S\n]*(?P<value>[^\s#].*?)[,;]?[^\S\n]*(?:\s[#;].*)?$", re.M)
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token|apikey|digest|negotiate)[^\S\n]+(?=\S+$)")
#: Words of prose, which a passphrase in a line doesn't hold; and how many words it has.
_PROSE = frozenset("a an and are as at be been but by can der die das do for from has have if in is it le la les must not of on or shall should that the this to was will with you your und un una el est et".split())
PHRASE_WORDS = range(3, 13)
_INSERT = re.compile(r"\$\{(\w[\w.]*)\}|\$\((\w[\w.]*)\)|(?<![\w$])\{(\w[\w.]*)\}|\$(\w+)")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+")


@dataclass
class Literal:
    value: str | None  # None for one that is too long
    places: list[tuple[int, int]] = field(default_factory=list)
    line: bool = False


_TOO_LONG = Literal(None)


def _built(value: str, places: list[tuple[int, int]]) -> Literal:
    """A value put together from constants, and the distinct places of its parts."""
    return Literal(value, list(dict.fromkeys(places))) if len(value) <= LONGEST else _TOO_LONG


def name_parts(name: str) -> list[str]:
    return [x.lower() for x in _PART.findall(re.split(r"\.|::|->", name)[-1])] or [x.lower() for x in _PART.findall(name)]


def name_score(name: str) -> float:
    """How much a value of this name is expected to be a secret, 0 to 0.7."""
    parts = name_parts(name)
    best = max([WORDS.get(x, 0.0) for x in parts] + [PAIRS.get(x, 0.0) for x in zip(parts, parts[1:])] + [WORDS.get("".join(parts), 0.0)], default=0.0)
    return best * (0.4 if HARMLESS & set(parts) else 1.0)


def entropy(value: str) -> float:
    """Bits per character of the distribution of its characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, 0 to 0.5; negative where it can't be one."""
    if len(value) < 6 or _PLACEHOLDER.match(value) or value.startswith(("http://", "https://", "/", "./")):
        return -1.0
    if _KNOWN.match(value):
        return 0.5
    if " " in value.strip() and entropy(value) < 4.2:
        return -0.3
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    mixed = 0.1 if kinds >= 2 else 0.0
    dense = min(0.25, max(0.0, (entropy(value) - 2.5) * 0.125))
    long = 0.15 if len(value) >= 20 and not re.fullmatch(r"[^\W\d_]+", value) else 0.05 if len(value) >= 10 else 0.0
    return mixed + dense + long


def passphrase(value: str) -> bool:
    words = value.lower().split()
    return len(words) in PHRASE_WORDS and len(value) >= 16 and all(w.isalpha() for w in words) and not _PROSE & set(words)


def score(name: str, value: str | None, line: bool = False) -> float:
    """Of a pair, 0 to 1.2; a known format is a secret under any name, a passphrase in a line under that of a secret."""
    own = name_score(name)
    if value is None or not own and not _KNOWN.match(value):
        return 0.0
    look = 0.1 if line and own >= 0.6 and passphrase(value) else literal_score(value)
    if look < LEAST_LOOK:
        return 0.0
    return own + look if own else 0.6


def lex(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of all tokens but white space. Comments are lexed like code: a secret in one leaks as well."""
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind in ("s1", "s2", "s3", "s4", "s5"):
            kind = "string"
        if kind == "space":
            continue
        if kind == "string":
            g = next(k for k in ("s3", "s4", "s1", "s2", "s5") if m[k] is not None)
            out.append(("string", m[g], *m.span(g)))
        else:
            out.append((kind, m[0], m.start(), m.end()))
    return out


def pairs(text: str) -> list[tuple[str, Literal]]:
    """Name-literal pairs in order, with constants propagated; places are (start, end) in the text."""
    tokens = lex(text)
    known: dict[str, Literal] = {}
    out: list[tuple[str, Literal]] = []
    i, n = 0, len(tokens)
    while i < n:
        kind, word, _, end = tokens[i]
        name, at = None, i + 1
        if kind == "define" and i + 1 < n and tokens[i + 1][0] == "name":
            name, at = tokens[i + 1][1], i + 2
        elif kind in ("name", "string") and i + 1 < n:
            if tokens[i + 1][1] in _ASSIGN and tokens[i + 1][0] == "op":
                name, at = word, i + 2
                # `name: type = value`, and `name: str | None = value`
                if tokens[i + 1][1] == ":" and at < n and tokens[at][0] == "name":
                    j = at
                    while j < n and j < at + 6 and (tokens[j][0] == "name" or tokens[j][1] in ("|", "[", "]", "<", ">", "?")):
                        j += 1
                    if j < n and tokens[j][1] == "=" and tokens[j][0] == "op":
                        at = j + 1
                        if tokens[j - 1][0] == "name" and name_score(tokens[j - 1][1]) > name_score(word):  # prose before a name: `note: token = value`
                            name = tokens[j - 1][1]
            elif tokens[i + 1][1] == "]" and i + 2 < n and tokens[i + 2][1] in _ASSIGN and kind == "string":  # config["name"] = value
                name, at = word, i + 3
            elif kind == "name" and word.startswith("--") and tokens[i + 1][0] in ("string", "name", "number"):  # --name value
                name = word
        if name is None or at >= n:
            i += 1
            continue
        found, to = _line(text, tokens, i, at, name, known) or _value(text, tokens, at, known)
        if found is None:
            i += 1 if to <= i else max(to, i + 1) if to > at else at
            continue
        name = name.strip("-").strip()
        known[name] = found
        if "." in name:
            known.setdefault(name.rsplit(".", 1)[-1], found)
        if found.places:
            out.append((name, found))
        i = max(to, i + 1)
    return out


def _line(text: str, tokens: list, i: int, at: int, name: str, known: dict[str, Literal]) -> tuple[Literal, int] | None:
    """The bare value up to the end of the line or a comment, without a scheme word, and the token after it; None where that is no line of a configuration or no secret."""
    kind, word, start, end = tokens[i]
    if kind != "name" or at != i + 2 or tokens[i + 1][1] not in ("=", ":") or not name_score(name):
        return None
    if not _LINE_HEAD.match(text, text.rfind("\n", 0, start) + 1, start):
        return None
    op = tokens[i + 1][3]
    found = _LINE_REST.match(text, op)
    if not found or not found["value"]:
        return None
    value, begin = found["value"], found.start("value")
    if scheme := _SCHEME.match(value):
        value, begin = value[scheme.end() :], begin + scheme.end()
    blank = bool(re.search(r"\s", value))
    env = tokens[i + 1][1] == "=" and word.isupper() and tokens[i + 1][2] == end and begin == op and not blank
    if value[0] in "\"'`$" or "${" in value or value in known or blank and not passphrase(value):
        return None
    if not env and (value[0] in "([{<&*|>!" or re.match(r"[\w.:>-]+[(\[<]", value) or set("\"'`") & set(value)):  # code: a call, an index, a type, a literal
        return None
    literal = Literal(value, [(begin, begin + len(value))], True)
    if score(name, value, True) < THRESHOLD:
        return None
    to = at
    while to < len(tokens) and tokens[to][2] < begin + len(value):
        to += 1
    return literal, to


def _value(text: str, tokens: list, at: int, known: dict[str, Literal]) -> tuple[Literal | None, int]:
    """The value that starts at a token, and the token after it."""
    parts: list[Literal] = []
    i, n = at, len(tokens)
    while i < n:
        kind, word, start, end = tokens[i]
        if kind == "string":
            filled = _filled(word, known)
            parts.append(Literal(filled.value, [(start, end), *filled.places] if word else []))
            i += 1
        elif kind == "name" and (word in known and word.strip("-")):
            parts.append(known[word])
            i += 1
        elif i == at and kind in ("name", "number", "op") and word not in ("{", "(", "[", "<", "\"", "'", "&", "*"):
            if i + 1 < n and tokens[i + 1][1] in ("(", "[") and tokens[i + 1][2] == end:  # a call or an index: what is in it is parsed by itself
                return None, at
            if i + 1 < n and tokens[i + 1][1] in _ASSIGN and tokens[i + 1][0] == "op" and tokens[i + 1][1] != ":":  # the target of another pair
                return None, at
            if m := _BARE.match(text, start):  # an unquoted value of a configuration file or a shell
                bare = m[0].rstrip(".:")
                while i < n and tokens[i][2] < m.end():
                    i += 1
                filled = _filled(bare, known)
                if filled.value is None or filled.places:
                    return filled, i
                return Literal(bare, [(start, start + len(bare))]) if bare else None, i
            return None, at
        else:
            break
        j = i
        if j < n and tokens[j][0] == "string" and tokens[j][2] - tokens[j - 1][3] <= 3 and kind == "string":  # adjacent literals
            continue
        if j < n and tokens[j][1] in ("+", ".", "..", "&") and tokens[j][0] == "op" and j + 1 < n and (tokens[j + 1][0] == "string" or tokens[j + 1][1] in known):
            i = j + 1
            continue
        break
    return (_joined(parts), i) if i > at else (None, at)


def _joined(parts: list[Literal]) -> Literal:
    if len(parts) == 1:
        return Literal(parts[0].value, parts[0].places)
    if any(p.value is None for p in parts) or sum(len(p.value) for p in parts) > LONGEST:
        return _TOO_LONG
    return _built("".join(p.value for p in parts), [x for p in parts for x in p.places])


def _filled(value: str, known: dict[str, Literal]) -> Literal:
    """The value with inserted names replaced by their constants, and the places of those."""
    if "$" not in value and "{" not in value:
        return Literal(value)
    parts, at = [], 0
    for m in _INSERT.finditer(value):
        if (found := known.get(next(x for x in m.groups() if x))) is not None:
            parts += [Literal(value[at : m.start()]), found]
            at = m.end()
    return _joined([*parts, Literal(value[at:])]) if parts else Literal(value)


def secrets(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of every literal that is, or is part of, a secret; ascending and disjoint."""
    found: dict[tuple[int, int], tuple[str, float]] = {}
    for name, literal in pairs(text):
        s = score(name, literal.value, literal.line)
        if s >= threshold:
            for place in literal.places:
                if place not in found or found[place][1] < s:
                    found[place] = (name, s)
    out: list[tuple[int, int, str, float]] = []
    for (start, end), (name, s) in sorted(found.items()):
        if end > start and (not out or start >= out[-1][1]):
            out.append((start, end, name, round(s, 6)))
    return out


def redacted(text: str, found: list) -> str:
    parts, at = [], 0
    for start, end, *_ in found:
        parts += [text[at:start], "<SECRET>"]
        at = end
    return "".join((*parts, text[at:]))


def _anyhow(word: str) -> str:
    """A pattern of the word as the parts of a name may spell it: in any case, with anything but letters and digits between its letters."""
    return r"[^\p{L}\p{N}]*".join(word)


#: What a text must hold to have a pair that scores: a sensitive word in any spelling or a known format, and a way to assign. Java's syntax.
_ASSIGNS = "[=:]|#define|--"
_SENSITIVE = "(?iu)" + "|".join([*map(_anyhow, sorted({x for x in WORDS if not any(y in x and y != x for y in WORDS)} | {"connection"})), "akia", "gh[pousr]_", "xox[abprs]-", "sk[-_]", "aiza", "eyj", "-----begin"])


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, secrets, clean_text) of every document that holds a secret.

    secrets lists the literals with start and end in characters, the name they
    are assigned to and the score; in clean_text <SECRET> stands in their place.
    A literal that becomes part of a secret through a constant is listed where it
    is written. Null and empty texts hold none; a null doc_id is carried along;
    repeated rows are scanned one by one; an empty table gives no row. Of pairs
    that share a literal the one with the highest score is listed, the first one
    of equals. A very long text is lexed as a whole, in time that grows with its
    length. Columns other than doc_id and text are not read.
    """

    def make():
        def f(ids: list, texts: list) -> dict | None:
            found = [(i, t, s) for i, t in zip(ids, texts) if (s := secrets(t, threshold))]
            if not found:
                return None
            return {"doc_id": [i for i, _, _ in found], "secrets": [[{"start": a, "end": b, "name": k, "score": v} for a, b, k, v in s] for _, _, s in found], "clean_text": [redacted(t, s) for _, t, s in found]}

        return f

    rows = docs.where(F.col("text").rlike(_ASSIGNS) & F.col("text").rlike(_SENSITIVE))
    return map_batches(rows, [F.col("doc_id").cast("long"), "text"], "doc_id long, secrets array<struct<start:int,end:int,name:string,score:double>>, clean_text string", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
