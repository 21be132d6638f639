"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs,
schemes, identifier cues such as "IBAN" or "account", and digits. At an anchor a
deterministic parser expands to the left and right to the boundaries of an e-mail
address, a network address, a phone number or an account number, and validates
it: labels of a domain, octets, check digits (Luhn, mod 97), issuer ranges, the
lengths that each country's account numbers have. Postal addresses are not looked
for: they have no anchor.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, table

#: Cues of an account number, compared in lower case. A cue counts for a number that starts at most CUE_REACH characters after it.
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "reisepass", "passeport", "pasaporte", "customer no", "kundennummer", "routing", "driver's license", "national id", "personalausweis", "dni", "nif")
PHONE_CUES = ("phone", "mobile", "tel", "fax", "call", "telefon", "téléphone", "teléfono", "handy")
CUE_REACH = 24
_LOCAL = set("._%+-'")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}(?![\w-])")
_IPV4 = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)")
_PHONE = re.compile(r"\+[ ]?\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)")
_LOCAL_PHONE = re.compile(r"(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\w-])")
_CUED_PHONE = re.compile(r"\(?\d{1,5}\)?(?:[ ./-]?\d{2,5}){1,5}(?!\w)")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}(?![\w]|-\d)")
#: Lengths of the numbers of each issuer.
_LENGTHS = ((re.compile(r"4"), (13, 16, 19)), (re.compile(r"5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)"), (16,)), (re.compile(r"3[47]"), (15,)), (re.compile(r"3[0689]"), range(14, 20)), (re.compile(r"35|6011|64[4-9]|65|62"), range(16, 20)))
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,30}|(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?)(?!\w)")
_IBAN_LENGTHS = {
    country: int(size)
    for size, countries in (x.split(":") for x in "15:NO 16:BE 18:DK FO FI GL NL FK SD 19:MK SI 20:AT BA EE KZ LT LU XK MN 21:CH HR LI LV 22:BG BH CR DE GB GE IE ME RS VA 23:AE GI IL IQ OM SO TL 24:AD CZ ES MD PK RO SA SE SK TN VG 25:LY PT ST 26:IS TR 27:BI DJ FR GR IT MC MR SM 28:AL AZ BY CY DO GT HN HU LB NI PL SV 29:BR EG PS QA UA 30:JO KW MU YE 31:MT SC 32:LC 33:RU".replace(" 1", "|1").replace(" 2", "|2").replace(" 3", "|3").split("|"))
    for country in countries.split()
}
#: An account number with letters, as a cue may announce it.
_CODE = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*(?!\w)")
_ACCOUNT = re.compile(r"\d(?:[ -]?\d){5,19}(?![\w]|-\d)")
#: Eight groups of four with colons; the last two may be written as four octets.
_IPV6_LENGTH = 45
_USERINFO = re.compile(r"([^\s/@:]+):([^\s/@]+)@([\w.-]+)")
_NO_CUE = -(1 << 60)
Span = tuple[int, int, str]


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ACCOUNT_CUES:
        found.add_word(word, ("account", len(word)))
    for word in PHONE_CUES:
        found.add_word(word, ("phone", len(word)))
    for word in ("@", "://", "iban", *"0123456789"):
        found.add_word(word, ("digit" if word.isdigit() else word, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return _IBAN_LENGTHS.get(iban[:2].upper()) == len(iban) and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ends(run: str) -> Iterator[int]:
    """Where a number in groups may end, longest first: at the end of the run and before each of its blanks and hyphens."""
    yield len(run)
    yield from (k for k in range(len(run) - 1, 0, -1) if run[k] in " -")


def card(digits: str) -> bool:
    return any(n.match(digits) and len(digits) in lengths for n, lengths in _LENGTHS) and luhn(digits)


def _plain_digit(c: str) -> bool:
    return "0" <= c <= "9"


def email(text: str, at: int) -> Span | None:
    """The address around the at-sign, its local part of any length."""
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] in _LOCAL):
        start -= 1
    while start < at and not text[start].isalnum():  # punctuation before an address isn't part of it
        start += 1
    local = text[start:at]
    if not local or local[-1] == "." or ".." in local:
        return None
    found = _DOMAIN.match(text, at + 1)
    return (start, found.end(), "email") if found else None


def userinfo(text: str, at: int) -> Span | None:
    """user:password@host after the scheme that ends at `at`."""
    found = _USERINFO.match(text, at)
    return (found.start(), found.end(2), "login") if found else None


def number(text: str, at: int, account_cue: int, phone_cue: int) -> tuple[Span | None, int]:
    """What the run of characters around the digit at `at` is, and the position up to which it is decided."""
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    end = at + 1
    while end < len(text) and (text[end].isalnum() or text[end] == "_"):
        end += 1
    before = text[start - 1] if start else " "
    if start < at or not all(map(_plain_digit, text[start:end])):
        if found := _IBAN.match(text, start):
            for size in _ends(found[0]):
                if mod97(found[0][:size].replace(" ", "")):
                    return (start, start + size, "iban"), start + size
        span, to = _ipv6(text, start, end)
        return (span, to) if span else (_code(text, start, account_cue) or (None, to))
    if text[end : end + 1] == ":" or before == ":":
        span, to = _ipv6(text, start, end)
        if span:
            return span, to
    if before == "." and start > 1 and _plain_digit(text[start - 2]):
        return None, end
    if found := _IPV4.match(text, start):
        if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in found[0].split(".")):
            return (start, found.end(), "ip"), found.end()
        return None, found.end()
    plus = start - 1 if before == "+" else start - 2 if before == " " and start > 1 and text[start - 2] == "+" else -1
    if plus >= 0 and (found := _PHONE.match(text, plus)) and 8 <= len(_digits(found[0])) <= 15:
        return (plus, found.end(), "phone"), found.end()
    if before not in "-." and (found := _SSN.match(text, start)):
        return (start, found.end(), "ssn"), found.end()
    opened = start - 1 if before == "(" else start
    if (found := _LOCAL_PHONE.match(text, opened)) and (opened == start or found[0][0] == "("):
        return (opened, found.end(), "phone"), found.end()
    if found := _CARD.match(text, start):
        for size in _ends(found[0]):
            if card(_digits(found[0][:size])):
                return (start, start + size, "card"), start + size
    if 0 <= start - phone_cue <= CUE_REACH and (found := _CUED_PHONE.match(text, opened)) and 7 <= len(_digits(found[0])) <= 15:
        return (opened, found.end(), "phone"), found.end()
    if 0 <= start - account_cue <= CUE_REACH and (before != "-" or start < 2 or not text[start - 2].isalnum()) and (found := _ACCOUNT.match(text, start)):
        return (start, found.end(), "account"), found.end()
    return _code(text, start, account_cue) or (None, end)


def _code(text: str, start: int, account_cue: int) -> tuple[Span, int] | None:
    """The account number with letters or hyphens that the token at `start` is part of, shortly after a cue: six digits or more."""
    if not 0 <= start - account_cue <= 2 * CUE_REACH:
        return None
    while start > account_cue and (text[start - 1] == "-" or text[start - 1].isalnum()):
        start -= 1
    while text[start] == "-":
        start += 1
    found = _CODE.match(text, start)
    return ((start, found.end(), "account"), found.end()) if start - account_cue <= CUE_REACH and found and len(_digits(found[0])) >= 6 else None


def _ipv6(text: str, start: int, end: int) -> tuple[Span | None, int]:
    s, e = start, end
    while s and (text[s - 1] in ":." or text[s - 1] in "0123456789abcdefABCDEF") and start - s <= _IPV6_LENGTH:
        s -= 1
    while e < len(text) and (text[e] in ":." or text[e] in "0123456789abcdefABCDEF") and e - end <= _IPV6_LENGTH:
        e += 1
    run = text[s:e].rstrip(".")  # a longer one is none as a whole
    if len(run) <= _IPV6_LENGTH and run.count(":") >= 2 and not (s and text[s - 1].isalnum()) and not text[s + len(run) : s + len(run) + 1].isalnum():
        try:
            ipaddress.IPv6Address(run)
            return (s, s + len(run), "ip"), s + len(run)
        except ValueError:
            pass
    return None, end


def spans(text: str, cues: ahocorasick.Automaton) -> list[Span]:
    """Ascending disjoint (start, end, kind) of a text, in code points; of spans that overlap the first one stays."""
    out: list[Span] = []
    done, account_cue, phone_cue = 0, _NO_CUE, _NO_CUE
    low = lowered(text)
    for last, (kind, size) in cues.iter(low):
        span = None
        if kind == "digit":
            if last >= done:
                span, done = number(text, last, account_cue, phone_cue)
        elif kind == "@":
            if last >= done:
                span = email(text, last)
        elif kind == "://":
            span = userinfo(text, last + 1)
        elif last >= done and not low[max(last - size, 0) : last - size + 1].isalpha():
            if kind == "phone":
                phone_cue = last + 1
            else:
                account_cue = last + 1
        if span:
            while out and out[-1][1] > span[0] and span[2] == "email":  # a number in the local part belongs to the address
                out.pop()
            if not out or out[-1][1] <= span[0]:
                out.append(span)
                done = max(done, span[1] + (span[2] == "login"))  # the at-sign after a login starts no address
    return out


def redacted(text: str, found: list[Span]) -> str:
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join((*parts, text[at:]))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, clean_text) of every document that holds personal data.

    Spans are ascending and disjoint, with start and end in characters and a
    kind: email, login, phone, ip, ssn, card, iban or account. In clean_text the
    kind stands in their place. Null and empty texts hold none; a null doc_id is
    carried along; repeated rows are searched one by one; an empty table gives
    no row. Of spans that overlap the first one stays, but an e-mail address takes
    in what was found in its local part; at one place the kinds are tried in a
    fixed order. A very long text is searched as a whole, in one pass. Columns
    other than doc_id and text are not read.
    """

    def make():
        cues = automaton()

        def f(ids: list, texts: list) -> dict | None:
            found = [(i, t, s) for i, t in zip(ids, texts) if (s := spans(t, cues))]
            if not found:
                return None
            return {"doc_id": [i for i, _, _ in found], "spans": [[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, _, s in found], "clean_text": [redacted(t, s) for _, t, s in found]}

        return f

    # all kinds but an e-mail or a login hold a digit; those hold an at-sign
    rows = docs.where("text rlike '[@0-9]'")
    return map_batches(rows, [F.col("doc_id").cast("long"), "text"], "doc_id long, spans array<struct<start:int,end:int,kind:string>>, clean_text string", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
