r"""Personal data: patterns propose, checksums confirm, context words adjust (native).

Each kind has a pattern, a validator and a base score.  Words near a span raise or lower its score
(``CONTEXT_BEFORE`` code points before it, across one earlier match, and ``CONTEXT_AFTER`` after
it, up to the next match); spans at or over ``min_score`` are reported.  The four base kinds
(email, ip, card, phone) carry a score that context cannot bring below ``min_score``, so they always stay;
iban, national_id, local_phone and secret (keys, tokens and passwords) are added by the method.

Matches are leftmost and do not overlap within a kind.  Patterns use possessive loops and look
behind themselves, which changes no match but keeps time linear and the matcher's stack flat on
texts of many megabytes.  Positions are code points, end exclusive: the text is split at the
matches, and the lengths of the pieces are added up by doubling, in about log2(matches) passes over
the array, so time grows as n log n with the matches of a text.

Defined results: a null or empty text has no spans (empty string, its SHA-256); ties in start
are ordered by kind as listed, then end; repeated rows are judged one by one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_BEFORE = 48
CONTEXT_AFTER = 24
CONTEXT_BONUS = 0.4
CONTEXT_MALUS = 0.2
BLOCK = 1024  # code points of a block that a text is cut into to be redacted
MIN_SCORE = 0.5
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "national_id", "local_phone", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

# Fixed values of the contract, written with possessive loops.  In "email" and "ip" a match may
# begin only where a run begins or where the match before it ended (\G).
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+).-])[0-9]{3}[ -][0-9]{3}-[0-9]{4}(?![0-9-])",
    "secret": (
        r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,250}+|sk-[A-Za-z0-9]{20,250}+)(?![A-Za-z0-9])"
        r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
        r"|(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)\x20{0,3}[=:]\x20{0,3}[\"']?[a-z0-9+/_=.~-]{8,250}+[\"']?)"
    ),
}
# A cheap test that every match implies.
HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    "national_id": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}[ -][0-9]{3}-[0-9]{4}"),
    "secret": lambda t: t.rlike(r"AKIA|gh[opsu]_|xox[abprs]-|sk-|PRIVATE KEY|(?i:passw|pwd|secret|token|api[_-]?key)"),
}
SCORE = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.9, "national_id": 0.3, "local_phone": 0.3, "secret": 0.6}
CONTEXT = {
    "email": "e-?mail|contact|write to",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "national_id": "ssn|social security|national id|tax id",
    "local_phone": "phone|call|tel|mobile|fax",
    "secret": "key|secret|credential|login|password|token",
}
# Words that speak against an added kind.
AGAINST = {
    "iban": "part|serial|model|isbn",
    "national_id": "part|serial|model|order|invoice|version",
    "local_phone": "part|serial|model|order|invoice|version",
    "secret": "example|placeholder|dummy|sample",
}
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    figures = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97_ok(value: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number: first four signs last, letters as 10 to 35."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    codes = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.ascii(c))
    step = lambda a, c: F.when(c < 58, (a * 10 + (c - 48)) % 97).otherwise((a * 100 + (c - 55)) % 97)
    return F.aggregate(codes, F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The validator of ``kind``."""
    if kind == "ip":
        return value.rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")
    if kind == "card":
        return F.length(digits_of(value)).between(14, 19) & luhn_ok(digits_of(value))
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    if kind == "iban":
        return mod97_ok(value)
    if kind == "national_id":
        return ~value.rlike(r"^(?:000|666|9..)|-00-|0000$")
    if kind == "secret":  # an assigned value has a letter and a figure; known forms are sure
        value_part = F.regexp_replace(value, r"(?i)^[a-z_-]+\x20*[=:]\x20*", "")
        return value.rlike(r"^(?:AKIA|gh[opsu]_|xox|sk-|-----)") | (value_part.rlike("[0-9]") & value_part.rlike("[A-Za-z]"))
    return F.lit(True)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join) -> Column:
    """What ``join`` (a sum or a maximum, 0 at least) makes of all numbers up to each: log2(size) passes."""

    def double(acc: Column, k: Column) -> Column:
        step = F.pow(F.lit(2), k).cast("int")
        before = F.concat(F.array_repeat(F.lit(0), step), F.slice(acc, F.lit(1), F.size(acc) - step))
        return F.zip_with(acc, before, join)

    passes = F.ceil(F.log2(F.size(values).cast("double"))).cast("int")
    turns = F.when(F.size(values) > 1, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, values, double)


def spans_of(kind: str, text: Column, min_score: float = MIN_SCORE) -> Column:
    """Array of (start, rank, end, kind, score) of the confirmed spans of one kind."""
    found = F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0))
    around = F.split(text, PATTERN[kind], -1)
    parts = F.struct(found.alias("hits"), around.alias("gaps"))

    def measured(p: Column) -> Column:
        lengths = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["hits"])), p["hits"], lambda g, h: F.length(g) + F.length(h))
        return bound(lengths, lambda n: F.struct(p["hits"].alias("hits"), p["gaps"].alias("gaps"), running(n, lambda a, b: a + b).alias("ends")))

    def place(p: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            gap = lambda j: F.coalesce(F.get(p["gaps"], i + j), F.lit(""))
            last = F.right(F.coalesce(F.get(p["hits"], i - 1), F.lit("")), F.lit(CONTEXT_BEFORE))
            before = F.concat(F.right(gap(-1), F.lit(CONTEXT_BEFORE)), last, F.right(gap(0), F.lit(CONTEXT_BEFORE)))
            near = F.concat(F.right(before, F.lit(CONTEXT_BEFORE)), F.lit(" "), F.left(gap(1), F.lit(CONTEXT_AFTER)))
            end = F.get(p["ends"], i)
            return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("value"), near.alias("near"))

        return F.transform(p["hits"], one)

    placed = bound(bound(parts, measured), place)

    def score(x: Column) -> Column:
        has = lambda words: x["near"].rlike(rf"(?i)\b(?:{words})\b")
        base = F.lit(SCORE[kind]) + F.when(has(CONTEXT[kind]), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        if kind in AGAINST:
            base = base - F.when(has(AGAINST[kind]), F.lit(CONTEXT_MALUS)).otherwise(F.lit(0.0))
        return F.least(F.lit(1.0), base)

    scored = F.transform(
        F.filter(placed, lambda x: confirmed(kind, x["value"])),
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), score(x).alias("score")
        ),
    )
    sure = F.filter(scored, lambda x: x["score"] >= min_score)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    return F.when(HINT[kind](text), sure).otherwise(none)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: ``id_col``, the columns of ``keep``, and spans as an ordered array."""
    keep = keep or []
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_kind = docs.select(F.col(id_col), *keep, text.alias("__t")).select(
        id_col, *keep, *[spans_of(k, F.col("__t")).alias(f"__{k}") for k in KINDS]
    )
    return by_kind.select(id_col, *keep, F.sort_array(F.concat(*[F.col(f"__{k}") for k in KINDS])).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``<KIND>``; of overlapping spans the first names it.

    The text is read in blocks of BLOCK code points, so that a piece far on costs no more than one at the start.
    """

    def rebuilt(p: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK).cast("int")
            blocks = F.slice(p["blocks"], first + 1, F.greatest(F.lit(0), F.floor((b - 1) / BLOCK).cast("int") - first + 1))

            def cut(block: Column, j: Column) -> Column:
                lo = F.when(j == 0, a - first * BLOCK).otherwise(F.lit(0))
                return F.substr(block, lo + 1, F.least(b - (first + j) * BLOCK, F.lit(BLOCK)) - lo)

            return F.when(b <= a, F.lit("")).otherwise(F.array_join(F.transform(blocks, cut), ""))

        def one(x: Column, i: Column) -> Column:
            at = F.coalesce(F.get(p["ends"], i - 1), F.lit(0))
            return F.when(x["start"] >= at, F.concat(piece(at, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit(""))

        tail = piece(F.element_at(p["ends"], -1), F.length(text))
        return F.concat(F.array_join(F.transform(p["spans"], one), ""), tail)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = bound(F.transform(spans, lambda x: x["end"]), lambda e: running(e, lambda a, b: F.greatest(a, b)))
    parts = F.struct(spans.alias("spans"), blocks.alias("blocks"), ends.alias("ends"))
    return F.when(F.size(spans) == 0, text).otherwise(bound(parts, rebuilt))
