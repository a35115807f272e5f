"""Text expressions: identifiers, paths, addresses, hashes, and the checks of generated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that never name a concept, in the order of their kinds (English, programming, literals, short).
STOPWORDS = [
    "a", "an", "the", "of", "for", "in", "on", "at", "to", "from", "with",
    "by", "as", "or", "and", "if", "then", "else", "not", "no",
    "is", "be", "do", "have", "has", "had", "this", "that", "it", "its",
    "get", "set", "fn", "func", "method", "var", "val", "init", "self",
    "this_", "tmp", "temp", "ret", "res",
    "true", "false", "none", "null", "nil",
    "x", "y", "z", "n", "i", "j", "k", "v",
]
TOKEN = r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"


def split_identifier(c: Column) -> Column:
    """camelCase, PascalCase, ACRONYMWord, snake_case and digits into tokens; ASCII only."""
    return F.regexp_extract_all(c, F.lit(TOKEN), 1)


def canonical(token: Column, aliases: dict[str, str] | None = None) -> Column:
    """A token's concept: alias, else not short, not a stopword, not a number, singular, alias again; or null."""
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else None
    low = F.lower(token)
    plural = (F.length(low) >= 4) & low.endswith("s") & ~low.endswith("ss")
    single = F.when(plural, F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)
    plain = F.when((F.length(low) < 2) | low.isin(STOPWORDS) | low.rlike("^[0-9]+$"), F.lit(None)).otherwise(
        F.coalesce(known[single], single) if known is not None else single
    )
    return F.coalesce(known[low], plain) if known is not None else plain


def concepts_of(identifier: Column, aliases: dict[str, str] | None = None) -> Column:
    return F.array_compact(F.transform(split_identifier(identifier), lambda t: canonical(t, aliases)))


#: The most characters of an identifier that stands for itself (fixed value).
SHORT_IDENTIFIER = 30


def alternate(concept: Column, identifier: Column, aliases: dict[str, str] | None = None) -> Column:
    """The form under which an identifier shows a concept: a short one itself, of a long one the first token of that concept."""
    of = F.filter(split_identifier(identifier), lambda t: F.coalesce(canonical(t, aliases) == concept, F.lit(False)))
    return F.when(F.length(identifier) <= SHORT_IDENTIFIER, identifier).otherwise(F.coalesce(F.get(of, 0), identifier))


# -- paths


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def extension(p: Column) -> Column:
    """The last suffix in lower case, with its dot; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(basename(p), r"^.+(\.[^.]+)$", 1))


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"^(.+)\.[^.]+$", "$1")


def normal_path(p: Column) -> Column:
    """"." and empty segments go, ".." takes the segment before it; null if it leads out of the root."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit(True).alias("ok"))

    def step(a: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(a["out"]) == 0)
        cut = F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0)))
        out = F.when(s.isin("", "."), a["out"]).when(s == "..", cut).otherwise(F.concat(a["out"], F.array(s)))
        return F.struct(out.alias("out"), (a["ok"] & ~up).alias("ok"))

    walked = F.aggregate(F.split(p, "/"), start, step, lambda a: F.when(a["ok"], F.array_join(a["out"], "/")))
    return F.when(~p.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), p).otherwise(walked)  # most paths have no such segment


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading segments two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1)


# -- addresses, hashes, numbers


def percent_encode(c: Column) -> Column:
    """All but letters, digits and _.-~ as %XX; the form encoding's own ways with blanks, * and ~ are undone."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def fnv1a(c: Column) -> Column:
    """The 32-bit FNV-1a hash of a text, a UTF-16 unit at a time; characters beyond the basic plane are two units."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit(".{4}"), F.lit(0))

    def step(h: Column, x: Column) -> Column:
        mixed = h.bitwiseXOR(F.conv(x, 16, 10).cast("bigint"))
        return F.pmod(mixed * 16777619, F.lit(4294967296))

    return F.aggregate(units, F.lit(2166136261).cast("bigint"), step)


def compact_number(c: Column) -> Column:
    """1234 as 1.2k, 1200000 as 1.2M."""
    return (
        F.when(c >= 1_000_000, F.concat(F.format_number(c / 1_000_000, 1), F.lit("M")))
        .when(c >= 1_000, F.concat(F.format_number(c / 1_000, 1), F.lit("k")))
        .otherwise(c.cast("string"))
    )


def iso_utc(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# -- generated text


def trimmed(c: Column) -> Column:
    """A text without blanks of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def n_sentences(c: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(c, r"[.!?]+(?:\s|$)"), lambda s: s.rlike(r"\S"))))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda s: s != ""))


#: The most characters of an annotation, sentences by kind (others up to 20), words of a summary, and
#: the texts that a kind may give instead of an answer.
MOST_CHARS = 2000
SENTENCES = {"file_summary": 3, "concept_description": 10, "schema_purpose": 8}
OTHER_SENTENCES = 20
SUMMARY_WORDS = 60
SENTINELS = {
    "file_summary": "empty file",
    "concept_description": "insufficient context to characterize this concept",
}
#: How a refusal reads.
REFUSALS = [
    r"\bi'?m sorry\b", r"\bi am sorry\b", r"\bi apologi[sz]e\b", r"\bi (?:can ?not|can't|cannot)\b",
    r"\bi'?m (?:unable|not able)\b", r"\bi am (?:unable|not able)\b", r"\bas an ai\b", r"\bas a language model\b",
    r"\bi don'?t have (?:access|the ability)\b", r"\bunable to (?:assist|help|comply)\b",
]


def unfenced(c: Column) -> Column:
    """A text without the code fence around all of it, trimmed."""
    t = trimmed(c)
    inner = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)\n\s*```[^\n]*$", 1)
    return F.when(t.rlike(r"(?s)^```[^\n]*\n(?:.*\n)?\s*```[^\n]*$"), trimmed(inner)).otherwise(t)


def rejection(kind: Column, raw: Column) -> Column:
    """Why an annotation isn't taken, the first reason that holds; null if it is taken."""
    t = unfenced(raw)
    most = F.lit(OTHER_SENTENCES)
    for k, n in SENTENCES.items():
        most = F.when(kind == k, n).otherwise(most)
    sentinel = F.lit(False)
    for k, text in SENTINELS.items():
        sentinel = sentinel | ((kind == k) & (F.lower(t) == text))
    return (
        F.when(raw.isNull(), "not_a_string")
        .when(t == "", "empty")
        .when(sentinel, F.lit(None))
        .when(F.length(t) > MOST_CHARS, "too_long")
        .when(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), "control_characters")
        .when(t.rlike("(?i)" + "|".join(REFUSALS)), "refusal")
        .when(t.rlike(r"(?im)^\s*(?:SYSTEM|USER|ASSISTANT)\s*:"), "prompt_echo")
        .when(F.contains(t, F.lit("```")), "code_fence")
        .when(n_sentences(t) > most, "sentence_count")
        .when((kind == "file_summary") & (n_words(t) > SUMMARY_WORDS), "too_many_words")
    )
