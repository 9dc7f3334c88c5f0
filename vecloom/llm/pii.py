"""Personal data by regular expressions, checksums and context words, in DataFrame functions only.

A pattern's matches are regexp_extract_all(text, p); the stretches between them are split(text, p).  Their lengths give
the spans in code points, and the stretches give the context.  Repeated groups in the patterns are possessive, which
Java runs as a loop: no text is long enough to exhaust the stack.  A pattern starts at the start of a run of its first
class, or where the last match ended; no other start can succeed where that one fails, so long runs cost no more than
their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The countries of the IBAN registry by the length of their numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_REGISTERED = "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
# Other numbers end where their run ends, or before a registered country's.
_OTHER = rf"[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]|\x20(?!(?:{'|'.join(IBAN_LENGTHS.values())})[0-9]{{2}})[A-Z0-9]){{11,30}}+(?![A-Za-z0-9])"
# The kinds, in the order in which equal starts are listed, and their patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_REGISTERED}|{_OTHER})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
# What a text must hold for the pattern to be tried at all: a necessary condition of each pattern.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "ssn": r"[0-9]{2}-[0-9]{4}",
}
# Score of a span by pattern alone, and the words nearby that raise it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT_CHARS, CONTEXT_GAIN, CHECKSUM_GAIN, ACCEPT = 40, 0.2, 0.1, 0.5
BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of the elements up to each, in blocks: the work grows as n * BLOCK, not as n * n."""
    block = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda j: F.aggregate(F.slice(lengths, j * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))
    before = F.transform(block, lambda _, j: F.aggregate(F.slice(block, F.lit(1), j), F.lit(0), lambda a, x: a + x))
    return F.transform(
        lengths, lambda _, i: F.element_at(before, F.floor(i / BLOCK).cast("int") + 1) + F.aggregate(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1), F.lit(0), lambda a, x: a + x)
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(digits.substr(-i, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits) leaves remainder 1: the first four characters count last."""
    turned = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    digits = F.length(_digits(m))
    if kind == "card":
        return F.when(digits.between(12, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return digits.between(9, 15)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.substr(5, 2).eqNullSafe("00") & ~m.substr(8, 4).eqNullSafe("0000")
    return F.lit(True)


def _found(kind: str) -> Column:
    """array<struct<start, kind, end, match, before, after>> of all matches of a pattern in column text."""
    pattern = F.lit(PATTERNS[kind])
    need = F.col("text").contains("@") if kind == "email" else F.col("text").rlike(NEEDS[kind])
    return F.when(need, F.struct(F.split(F.col("text"), PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(F.col("text"), pattern, F.lit(0)).alias("hit")))


def _spans(kind: str, order: int) -> Column:
    gap, hit = F.col(f"{kind}_m.gap"), F.col(f"{kind}_m.hit")
    ends = F.col(f"{kind}_e")
    return F.filter(
        F.transform(
            hit,
            lambda m, i: F.struct(
                (F.get(ends, i) - F.length(m)).alias("start"),
                F.lit(order).alias("kind"),
                F.get(ends, i).alias("end"),
                m.alias("hit"),
                F.lower(F.concat(F.right(F.get(gap, i), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.get(gap, i + 1), F.lit(CONTEXT_CHARS)))).alias("near"),
            ),
        ),
        lambda s: _valid(kind, s["hit"]),
    )


def _scored(kind: str, spans: Column) -> Column:
    words = "|".join(CONTEXT[kind])
    checksum = CHECKSUM_GAIN if kind in ("card", "iban") else 0.0
    score = lambda s: F.lit(PRIOR[kind] + checksum) + F.when(s["near"].rlike(rf"(?<![a-z])(?:{words})"), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
    out = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.round(score(s), 2).alias("score")))
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= ACCEPT)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<start, kind, end, score>> of each row, by start, then kind (index into PATTERNS)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.select("doc_id", *[_found(k).alias(f"{k}_m") for k in PATTERNS])
    lengths = lambda k: F.transform(F.col(f"{k}_m.hit"), lambda m, i: F.length(F.get(F.col(f"{k}_m.gap"), i)) + F.length(m))
    df = df.select("*", *[lengths(k).alias(f"{k}_l") for k in PATTERNS])
    df = df.select("*", *[F.when(F.size(f"{k}_l") > 0, _running(F.col(f"{k}_l"))).alias(f"{k}_e") for k in PATTERNS])
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,score:double>>)")
    parts = [F.coalesce(F.when(F.size(f"{k}_l") > 0, _scored(k, _spans(k, i))), none) for i, k in enumerate(PATTERNS)]
    return df.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_ssn, scores of each row of docs(doc_id, text).

    Base kinds are reported whenever pattern and validator hold; iban and ssn also need a score of ACCEPT.  scores has
    the score of each span of `spans`, in the same order.

    Defined cases: null text is empty and has no spans (empty strings, the hash of the empty string); null and repeated
    doc_ids are rows like all others.  Other columns of docs are ignored, whatever their names.
    """
    names = F.array(*map(F.lit, PATTERNS))
    word = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == list(PATTERNS).index(k))).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("found", lambda s: s["kind"] < len(BASE)), word), ",")
    return pii_spans(docs).select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("found", word), ",").alias("spans"),
        count("iban"),
        count("ssn"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
