"""Documents with every odd case, and plain-Python versions of the contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, value string, y int, score double, spans string"

LONG = "lorem ipsum dolor sit amet " * 400
PASSAGE = " ".join(f"w{i * i % 97}x{i}" for i in range(70))
SPEECH = " ".join(f"unit{i}" for i in range(120))


def texts():
    return [
        None,
        "",
        " \t\n ",
        "one",
        "one two three four",
        "ONE two three four",
        "one two three four five six seven eight nine ten eleven",
        "same line here\nsame line here\r\n\n\nother line 😀 tail\nsame line here",
        "a b c d e a b c d e a b c d e x y z",
        LONG,
        LONG,
        f"first {PASSAGE} end",
        f"second thing {PASSAGE} other end",
        PASSAGE,
        SPEECH,
        SPEECH.replace("unit60 ", "changed "),
        SPEECH.replace("unit3 ", "altered "),
        SPEECH + " more",
        "mail bob.smith+x@mail.example.com, then a@b.c%x@d.e 😀 and x@y and 10.0.0.256 1.2.3.4.5.6.7.8 0255.1.1.1",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 call +1 (171) 555-2028 or +12 34 phone 212 555-1234",
        "iban DE89 3704 0044 0532 0130 00 and DE88370400440532013000 ssn 123-45-6789 or 123-45-6789",
        "+1 22 333 4444 55 666@a.bb.cc.dd. 999.1.1.1 127.0.0.1",
        "é" * 450,
        "é" * 449 + "e" + "é" * 30,
        "### $$$ *** !!! JUNK!! JUNK!! JUNK!!",
        "the end",
        "the end",
    ]


def rows():
    return [(i * 3, t, "en", "s", len(t or ""), 1, "x", "y", 0, 0.5, "q") for i, t in enumerate(texts())]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spans(text):
    text = text or ""
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        t = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (2 if i % 2 else 1)
            t += v - 9 if v > 9 else v
        return t % 10 == 0

    ok = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 14 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v)),
        "phone": lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(pats.items()) for m in re.finditer(p, text) if ok[k](m.group(0))]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def word_stats(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(pairs):
    """doc -> smallest doc reachable, from (doc, text) pairs."""
    sets = {d: shingles(t) for d, t in pairs}
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def repeated_windows(pairs, width=50):
    """doc -> (n_words, n_removed, sha of what is kept)."""
    words = {d: WORD.findall(t or "") for d, t in pairs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for j in range(width)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeated_bytes(pairs, width=400):
    """doc -> (n_bytes, n_removed, n_spans, sha of what is kept)."""
    data = {d: (t or "").encode() for d, t in pairs}
    starts = Counter(b[i : i + width] for b in data.values() for i in range(len(b) - width + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if starts[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans_ = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans_, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out
