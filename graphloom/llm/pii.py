r"""Personal data in texts, in DataFrame operations alone.

Regular expressions propose spans, checksums (Luhn for cards, mod-97 for account numbers) and value ranges
confirm them, and context words shortly before a span adjust its score. Spans are code points, end exclusive.

Expressions begin only where a run of their first class begins and use possessive repeats, so a text is read
in linear time and no long run overflows the matcher's stack; the matches are those of the plain expressions:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)      each part at most 255
    card   [0-9]([\x20-]?[0-9])+                      14 to 19 digits that pass Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9]                 10 to 15 digits
    iban   two capitals, two digits, 11 to 30 more    mod-97 is 1
    local  ten digits written as a phone number       a context word must stand before it

The first four are the base kinds: they are reported whatever their score. The others need a score of
`threshold`, and no base span may touch them. A null or empty text has no spans, a long one is read whole, equal rows
give equal spans, and an empty table gives an empty one. Rows are returned one for one with all their columns, none of
which may be called `pii`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import new_columns

KINDS = ["email", "ip", "card", "phone", "iban", "local"]
BASE = KINDS[:4]

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: A text in which this isn't found has no match; these are cheaper than the patterns.
GATES = {"email": "@", "phone": "+"}
#: Context words of each kind, in lower case, and scores without and with one of them.
CONTEXT = {
    "email": (r"e-?mail|mail|contact|write", 0.8, 1.0),
    "ip": (r"\bip\b|address|host|server|adresse|dirección", 0.6, 0.9),
    "card": (r"card|visa|credit|payment|carte|karte|tarjeta", 0.8, 1.0),
    "phone": (r"phone|tel|call|mobile|fax|téléphone|telefon|teléfono", 0.7, 1.0),
    "iban": (r"iban|account|bank|konto|compte|cuenta", 0.8, 1.0),
    "local": (r"phone|tel|call|mobile|fax|téléphone|telefon|teléfono", 0.3, 0.7),
}
#: Characters before a span in which a context word counts.
NEAR = 40
SPAN = "struct<start:int,k:int,end:int,score:double>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn checksum."""
    reverse = F.split(F.reverse(digits), "")

    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    values = F.transform(F.filter(reverse, lambda c: c != ""), worth)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """The remainder of an account number: its first four characters last, letters as 10 to 35."""
    tidy = F.regexp_replace(code, " ", "")
    moved = F.concat(F.substr(tidy, F.lit(5)), F.substr(tidy, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m) == 1
    return F.lit(True)


#: Matches whose places are added up at a time, so that long lists aren't copied for each of their entries.
BLOCK = 64


def _spans(kind: str) -> Column:
    """Valid matches of a kind as SPANs, from its matches m_<kind> and the pieces between them p_<kind>."""
    words, low, high = CONTEXT[kind]
    none = F.array().cast(f"array<{SPAN}>")
    n = F.size(f"m_{kind}")

    def step(a: Column, i: Column) -> Column:
        piece, m = F.get(F.col(f"p_{kind}"), i), F.get(F.col(f"m_{kind}"), i)
        start = a["at"] + F.char_length(piece)
        end = start + F.char_length(m)
        near = F.right(F.concat(a["tail"], piece), F.lit(NEAR))
        score = F.when(F.lower(near).rlike(words), high).otherwise(low)
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), end.alias("end"), score.alias("score")
        )
        return F.struct(
            end.alias("at"),
            F.when(_valid(kind, m), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"),
            F.right(F.concat(near, m), F.lit(NEAR)).alias("tail"),
        )

    def block(first: Column) -> Column:
        """The matches from one on, with places counted from the front of its piece."""
        own = F.sequence(first, F.least(first + BLOCK - 1, n - 1))
        k = F.least(first, F.lit(NEAR // 4))  # a match has five characters or more
        last = F.zip_with(F.slice(f"p_{kind}", first - k + 1, k), F.slice(f"m_{kind}", first - k + 1, k), lambda a, b: F.concat(a, b))
        tail = F.right(F.array_join(last, ""), F.lit(NEAR))
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), none.alias("out"), tail.alias("tail")), step)

    def place(a: Column, x: Column) -> Column:
        moved = F.transform(
            x["out"],
            lambda y: F.struct((y["start"] + a["at"]).alias("start"), y["k"].alias("k"), (y["end"] + a["at"]).alias("end"), y["score"].alias("score")),
        )
        return F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(moved)).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), block)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    return F.when(n > 0, F.flatten(F.aggregate(blocks, start, place, lambda a: a["out"]))).otherwise(none)


def find_pii(documents: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """The documents with `pii`, an array of (kind, start, end, score) by start, then kind as listed."""
    kept = documents.columns
    new_columns(kept, ["pii"])
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    body = F.col("row").getField(text)
    matches, pieces = {}, {}
    none = F.array().cast("array<string>")
    for kind in KINDS:
        gate = F.contains(body, F.lit(GATES[kind])) if kind in GATES else body.rlike("[0-9]")
        matches[f"m_{kind}"] = F.when(gate, F.regexp_extract_all(body, F.lit(PATTERNS[kind]), 0)).otherwise(none)
        pieces[f"p_{kind}"] = F.when(F.size(f"m_{kind}") > 0, F.split(body, PATTERNS[kind], -1)).otherwise(none)
    found = rows.withColumns(matches).withColumns(pieces)
    found = found.select("row", *(_spans(k).alias(f"s_{k}") for k in KINDS))
    base = F.concat(*(F.col(f"s_{k}") for k in BASE))
    extra = F.concat(*(F.col(f"s_{k}") for k in KINDS[4:]))

    def clear(x: Column) -> Column:
        """Scored high enough and apart from every base span."""
        apart = F.forall(F.col("base"), lambda b: (b["end"] <= x["start"]) | (b["start"] >= x["end"]))
        return (x["score"] >= threshold) & apart

    named = F.transform(
        F.array_sort(F.concat("base", F.filter("extra", clear))),
        lambda x: F.struct(
            F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind"), x["start"], x["end"], x["score"]
        ),
    )
    return found.select("row", base.alias("base"), extra.alias("extra")).select("row", named.alias("pii")).select("row.*", "pii")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(kinds))
