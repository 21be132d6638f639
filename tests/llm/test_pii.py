from brindle.llm import pii

from .helpers import AWKWARD, empty, frame

CASES = {
    "write to jo.doe+x@mail.example.com. now": [("jo.doe+x@mail.example.com", "email")],
    "UPPER.37@MAIL3.EXAMPLE.COM!! and (a@b.co)": [("UPPER.37@MAIL3.EXAMPLE.COM", "email"), ("a@b.co", "email")],
    "una.89@mail7.example.com###": [("una.89@mail7.example.com", "email")],
    "no.@x.com a..b@x.com a@b @c d@ e@-x.com": [],
    "call +1 (394) 555-4006 or 555-123-4567": [("+1 (394) 555-4006", "phone"), ("555-123-4567", "phone")],
    "Telefon: 030/1234567, call 911": [("030/1234567", "phone")],
    "10.0.0.1 and 255.255.255.255": [("10.0.0.1", "ip"), ("255.255.255.255", "ip")],
    "999.1.1.1 1.2.3.4.5 v1.2.3.4x 01.2.3.4": [],
    "2001:db8::1 ends": [("2001:db8::1", "ip")],
    "at 12:30:45 o'clock": [],
    "card 4532015112830366": [("4532015112830366", "card")],
    "4532 0151 1283 0366 5500-0000-0000-0004": [("4532 0151 1283 0366", "card"), ("5500-0000-0000-0004", "card")],
    "4532015112830367 9532015112830366": [],
    "ssn 123-45-6789 not 000-45-6789": [("123-45-6789", "ssn")],
    "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE00 3704 0044 0532 0130 00": [("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban")],
    "account no 12345678, and much further on 87654321": [("12345678", "account")],
    "ftp://bob:hunter2@host.example.com/x": [("bob:hunter2", "login")],
    "hash 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde in 1999, 42 of 3,000.50": [],
    "": [],
}


def test_cases():
    cues = pii.automaton()
    for text, expected in CASES.items():
        assert [(text[a:b], k) for a, b, k in pii.spans(text, cues)] == expected, text


def test_offsets_survive_case_mapping():
    text = "İİİ me@x.org"
    assert [(text[a:b], k) for a, b, k in pii.spans(text, pii.automaton())] == [("me@x.org", "email")]


def test_frame(spark):
    found = {r.doc_id: r for r in pii.find(frame(spark, [*AWKWARD, (1, "a@b.co and 10.0.0.1", "en", "s"), (1, "a@b.co and 10.0.0.1", "en", "s"), (None, "c@d.org", "en", "s"), (2, "y " * 200_000 + "z@y.net", "en", "s")])).collect()}
    assert set(found) == {1, None, 2}
    assert found[1].clean_text == "<EMAIL> and <IP>" and [s.kind for s in found[1].spans] == ["email", "ip"]
    assert found[2].spans[0].start == 400_000
    assert pii.find(empty(spark)).count() == 0


def test_all_planted(spark, small):
    """Every match of plain patterns in the documents is found."""
    import re

    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    found = {r.doc_id: r for r in pii.query(spark, small).collect()}
    for d in docs:
        kinds = [s.kind for s in found[d.doc_id].spans] if d.doc_id in found else []
        assert kinds.count("email") == len(re.findall(r"\w+\.\d+@\w+\.example\.com", d.text, re.I))
        assert kinds.count("phone") == len(re.findall(r"\+1 \(\d{3}\) 555-\d{4}", d.text))


def test_number_behind_a_number():
    cases = {
        "4111 1111 1111 1111 12/25": [("4111 1111 1111 1111", "card")],
        "4532015112830366 123": [("4532015112830366", "card")],
        "5500-0000-0000-0004 99 3782 822463 10005 1234": [("5500-0000-0000-0004", "card"), ("3782 822463 10005", "card")],
        "AT61 1904 3002 3457 3201 BIC 7": [("AT61 1904 3002 3457 3201", "iban")],
        "AT61 1904 3002 3457 3202 BIC 7": [],
        "4111 1111 1111 1112 12/25": [],
    }
    for text, expected in cases.items():
        assert [(text[a:b], k) for a, b, k in pii.spans(text, pii.automaton())] == expected, text


def test_boundaries():
    cases = {
        "a" * 70 + ".b@mail.example.com x": [("a" * 70 + ".b@mail.example.com", "email")],
        "account: A-4455-9912, then": [("A-4455-9912", "account")],
        "Kontonummer konto AB12345678.": [("AB12345678", "account")],
        "account x-1 and y-2": [],
        "de89370400440532013000 and gb82 west 1234 5698 7654 32": [("de89370400440532013000", "iban"), ("gb82 west 1234 5698 7654 32", "iban")],
        "XX89370400440532013000 DE8937040044053201300": [],
        "1:2:3:4:5:6:7:8": [("1:2:3:4:5:6:7:8", "ip")],
        ":".join("1234" for _ in range(30)): [],
        "0000:0000:0000:0000:0000:ffff:192.168.100.228": [("0000:0000:0000:0000:0000:ffff:192.168.100.228", "ip")],
    }
    for text, expected in cases.items():
        assert [(text[a:b], k) for a, b, k in pii.spans(text, pii.automaton())] == expected, text


def naive(text):
    """What may be found, by asking at every position whether a whole entity of a kind begins there; no anchors, no expansion."""
    import ipaddress
    import re

    out = []
    i = 0
    free = lambda k: k < 0 or k >= len(text) or not (text[k].isalnum() or text[k] == "_")
    while i < len(text):
        hit = None
        m = re.compile(r"[a-z0-9][a-z0-9._%+'-]*(?<!\.)@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}(?![\w-])").match(text, i)
        if m and ".." not in m[0].split("@")[0] and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "._%+-'")):
            hit = m.end(), "email"
        if not hit and free(i - 1):
            for j in range(min(len(text), i + 45), i, -1):
                part = text[i:j]
                if not free(j) or not part[-1].isalnum():
                    continue
                digits, plain = re.sub(r"[ -]", "", part), re.sub(" ", "", part)
                if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", part) and not re.match(r"\.\d", text[j:]) and text[i - 1 : i] != ".":
                    try:
                        ipaddress.IPv4Address(part)
                        hit = j, "ip"
                    except ValueError:
                        pass
                elif re.fullmatch(r"\d([ -]?\d)+", part) and text[i - 1 : i] not in ("-", ".") and 13 <= len(digits) <= 19:
                    total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
                    if total % 10 == 0 and pii.card(digits):
                        hit = j, "card"
                elif re.fullmatch(r"[A-Za-z]{2}\d\d([A-Za-z0-9]+|( [A-Za-z0-9]{4})+( [A-Za-z0-9]{1,3})?)", part) and 15 <= len(plain) <= 34:
                    if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and pii._IBAN_LENGTHS.get(plain[:2].upper()) == len(plain):
                        hit = j, "iban"
                if hit:
                    break
        if hit:
            out.append((i, *hit))
            i = hit[0]
        else:
            i += 1
    return out


def test_against_all_positions():
    """Texts made of entities, broken ones and words: the anchors lead to what a search at every position finds."""
    import random

    draw = random.Random(7)

    def entity():
        kind = draw.randrange(9)
        name = "".join(draw.choices("abcdefgh", k=draw.randint(1, 8)))
        if kind == 0:
            return f"{name}.{draw.randrange(100)}@{name[::-1]}.example.{draw.choice(['com', 'org', 'c'])}"
        if kind == 1:
            return ".".join(str(draw.randrange(300)) for _ in range(draw.choice([3, 4, 4, 4])))
        if kind in (2, 3):
            head = "4" + "".join(draw.choices("0123456789", k=14))
            good = next(d for d in "0123456789" if pii.luhn(head + d))
            full = head + (good if draw.random() < 0.7 else str((int(good) + 1) % 10))
            return draw.choice([full, " ".join(full[k : k + 4] for k in range(0, 16, 4)), "-".join(full[k : k + 4] for k in range(0, 16, 4))])
        if kind in (4, 5):
            body = "".join(draw.choices("0123456789", k=18))
            check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
            full = f"DE{check if draw.random() < 0.7 else (check + 1) % 97:02d}{body}"
            return draw.choice([full, full.lower(), " ".join(full[k : k + 4] for k in range(0, 22, 4))])
        return name

    cues, kinds = pii.automaton(), {"email", "ip", "card", "iban"}
    some = 0
    for _ in range(400):
        text = draw.choice(["; ", ", and ", " / "]).join(entity() for _ in range(draw.randint(1, 6)))
        found = [x for x in pii.spans(text, cues) if x[2] in kinds]
        assert found == naive(text), text
        some += len(found)
    assert some > 300
