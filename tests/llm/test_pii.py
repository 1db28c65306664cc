import random
import re

from foliant.llm import pii
from foliant.llm.pii import LABELERS, base_spans, detect, fit, learn, luhn, redacted

# the definitions of the base spans, word for word
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and brute_luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_as_defined():
    r = random.Random(5)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "Z", ".", "@", "@", "-", "+", "1", "25", "4111 1111 1111 1111", "300", "0", " ", "(", "_", "%", "é", ".com", "10.0.0.1", "+49 30 12345"]) for _ in range(r.randrange(14)))
        assert base_spans(text) == brute(text), text
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_long_texts_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "+1" + "(" * 300_000, "a at " * 60_000, "123 " * 75_000):
        base_spans(text)
        pii.candidates(text, [])


CUED = ["Please call {} today", "phone: {}", "our tel {} is open", "fax {}"]


def corpus(r):
    rows = []
    for _ in range(400):
        n = f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
        rows.append(f"x {r.choice(CUED).format(n)} y")
        rows.append(f"order {r.randrange(100, 999)} {r.randrange(100, 200)} 0000 gone")
        rows.append(f"contact {r.choice(['jim', 'maria', 'li.wei'])} at {r.choice(['mail', 'post'])} dot {r.choice(['com', 'org'])} now")
        rows.append(f"they met at noon. Then dot x{r.randrange(9)} came")
    return rows


def test_learns_whom_to_believe(docs):
    rows = list(enumerate(corpus(random.Random(1))))
    model = fit(docs(rows))
    assert set(model.reliability) >= {"phone", "email"}
    assert all(0 <= x <= 1 for rel in model.reliability.values() for x in rel.values())
    out = {r.doc_id: r for r in detect(docs(rows), model).collect()}
    for i, text in rows:
        got = [s.kind for s in out[i].spans]
        assert out[i].base == []
        if i % 4 == 0:
            assert got == ["phone"], text
            s = out[i].spans[0]
            assert text[s.start : s.end].startswith("(") and "[PHONE]" in out[i].redacted
        elif i % 4 == 1:
            assert got == [] and out[i].redacted == text
        elif i % 4 == 2:
            assert got == ["email"], text
        else:
            assert got == [], text


def test_em_finds_the_noisy_labeler():
    r, counts = random.Random(2), {}
    for _ in range(5000):
        truth = r.random() < 0.5
        accuracy = (0.95, 0.9, 0.9, 0.55, 0.85)
        vote = "".join("+" if truth == (r.random() < a) else "-" for a in accuracy)
        counts["ip", vote, "00"] = counts.get(("ip", vote, "00"), 0) + 1
    got = learn(counts).reliability["ip"]
    for name, want in zip(LABELERS, (0.95, 0.9, 0.9, 0.55, 0.85)):
        assert abs(got[name] - want) < 0.05


def test_awkward(docs, awkward):
    rows = awkward + [(20, "😀 mail a@b.co or 10.0.0.1, 4111-1111-1111-1111; +49 (30) 123456"), (20, None)]
    got = detect(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for i, t in rows if i == r.doc_id]
        assert any([tuple(s) for s in r.base] == brute(t or "") for t in texts)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert detect(docs([])).count() == 0


def test_redaction_joins_overlaps():
    assert redacted("abcdefgh", [("ip", 1, 3), ("card", 2, 5), ("email", 6, 7)]) == "a[IP]f[EMAIL]h"
    assert redacted("abc", []) == "abc"


def test_gate_lets_all_spelled_addresses_through():
    for at in (" at ", " AT ", " At ", "[@]", " [@] ", "(at)", "{AT}", "( aT )", "[ @ ]"):
        for dot in (" dot ", " DOT ", "[.]", "."):
            text = f"mail: joe.smith{at}example{dot}org"
            assert [(k, text[a:z]) for k, a, z in pii.candidates(text, [])] == [("email", text[6:])], text
    r, parts = random.Random(6), ["joe", "firm", " ", "at", "AT", "@", "[", "]", "(", ")", "{", "}", "dot", ".", "org", "x1", "İ"]
    for _ in range(20_000):
        text = "".join(r.choices(parts, k=r.randrange(4, 14)))
        found = [("email", *m.span()) for m in pii._LOOSE["email"].finditer(text)]
        assert [c for c in pii.candidates(text, []) if c[0] == "email"] == found, text
