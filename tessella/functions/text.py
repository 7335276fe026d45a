"""Scalar helpers on columns: white space, terms, token counts, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a question's terms leave out.
STOPWORDS = (
    "the and for that this with from what which who whom whose how why when where are was were has have had does did "
    "say says said name missing complete entity between them about into over under their they its put order"
).split()
#: Fixed value: what parts terms.
TERM_BREAK = "[^a-z0-9åäöæøéèüß-]+"
#: Known digest algorithms and the length of their hex digits.
ALGORITHMS = {"sha256": 64, "sha512": 128}


def normalise_space(text: Column) -> Column:
    """Runs of white space, Unicode's included, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1C-\\x1F]+", " "))


def content_terms(query: Column) -> Column:
    """Distinct terms of three characters or more that aren't stopwords, in order."""
    parts = F.split(F.lower(query), TERM_BREAK)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def question_fit(terms: Column, text: Column) -> Column:
    """Share of the terms that the text contains; 0 without terms."""
    low = F.lower(text)
    hits = F.size(F.filter(terms, lambda t: low.contains(t)))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def token_count(text: Column) -> Column:
    """max(1, length / 4 rounded half up)."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4.0 + 0.5)).cast("long")


def unified_lines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def line_hash(text: Column) -> Column:
    """SHA-256 of the text with unified line ends, bare hex."""
    return F.sha2(unified_lines(text), 256)


def qualified_digest(digest: Column) -> Column:
    """'algorithm:hex' in lower case; bare hex is SHA-256; anything else raises."""
    low = F.lower(F.trim(digest))
    known = F.lit(False)
    for name, size in ALGORITHMS.items():
        known = known | low.rlike(f"^{name}:[0-9a-f]{{{size}}}$")
    bare = low.rlike("^[0-9a-f]{64}$")
    return F.when(digest.isNull(), F.lit(None)).when(known, low).when(bare, F.concat(F.lit("sha256:"), low)).otherwise(
        F.raise_error(F.concat(F.lit("unknown digest: "), digest)).cast("string")
    )


def payload_hash(canonical: Column) -> Column:
    """'sha256:' and the hex digest of canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def slug(text: Column) -> Column:
    """ASCII fold of common Latin letters, lower case, other runs as one hyphen."""
    folded = F.translate(F.lower(text), "åäáàâãöóòôõøéèêëíìîïúùûüñçýÿ", "aaaaaaooooooeeeeiiiiuuuuncyy")
    folded = F.replace(F.replace(folded, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-|-$", "")


def sentences(text: Column) -> Column:
    """Sentences of the paragraphs that blank lines part, trimmed, empty ones left out."""
    paragraphs = F.split(text, "\\n\\s*\\n")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.split(p, "(?<=[.!?])\\s+")))
    return F.filter(F.transform(parts, normalise_space), lambda s: s != "")
