"""Secrets in whole texts: three fixed kinds, and tokens that a randomness battery singles out.

Everything is a DataFrame expression. A pattern's matches and the gaps between them give the
spans: the gaps' and matches' lengths, added up, are positions in code points.

The battery looks at every long token. Its encoding is inferred from its characters; in the
encoding's alphabet of m characters a token of n characters gets

*   chi-squared against equal frequencies,
*   the number of runs of character kinds (digits, capitals, small letters, signs),
*   the serial correlation of neighbours' places in the alphabet.

Each is compared with what random characters give (the token has to pass all three at level
``GATE``) and the first two with what written language gives: the p-value is the larger of the
two probabilities that a text token looks as random as this one. Both narrow with n, so that a
short token needs more. A Benjamini-Hochberg threshold over all tokens of the corpus, weighted
by length, then bounds the share of false finds; weights are taken relative to their mean over
all tokens. The threshold is read off a histogram of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: kind: (pattern, group whose length counts, least length); fixed values of the base kinds.
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}

#: Tokens that the battery looks at.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding: (pattern, alphabet in order); fixed values.
ENCODINGS = {
    "hex": ("^(?=.*[0-9])[0-9a-f]+$", _DIGITS + "abcdef"),
    "HEX": ("^(?=.*[0-9])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "base32": ("^(?=.*[2-7])[A-Z2-7]+$", _UPPER + "234567"),
    "base36": ("^(?=.*[0-9])(?:[a-z0-9]+|[A-Z0-9]+)$", _DIGITS + _LOWER),
    "base64": ("^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": ("^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
}

#: A token has to be as random as this in each test of the battery.
GATE = 1e-3
#: Chance that neighbours in written text differ in kind.
_TEXT_CHANGES = 0.12
#: Sum of squared character frequencies in written text.
_TEXT_SQUARES = 0.07
#: A token's weight is its length, up to _LONGEST; p-values are stated for the weight _UNIT.
_LONGEST, _UNIT = 128, 32
#: Bins a power of ten of the p-values' histogram, and the powers it spans.
_STEPS, _POWERS = 50, 40


def _change_rate(alphabet: str) -> float:
    kinds = [sum(f(c) for c in alphabet) / len(alphabet) for f in (str.isdigit, str.isupper, str.islower)]
    return 1 - sum(k * k for k in kinds) - (1 - sum(kinds)) ** 2


def _by_encoding(kind: Column, value) -> Column:
    out = F.lit(None).cast("double")
    for name, (_, alphabet) in ENCODINGS.items():
        out = F.when(kind == name, F.lit(float(value(alphabet)))).otherwise(out)
    return out


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by a rational approximation that holds far out in the tail."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def spans(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<s, e, t>> of a pattern's matches ``found`` in ``text``, in code points."""
    kind = "array<struct<s:int,e:int,t:string>>"
    gaps = F.split(text, pattern, -1)
    folded = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (a["at"] + F.length(x["g"])).alias("s"),
                        (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e"),
                        x["m"].alias("t"),
                    )
                ),
            ).cast(kind).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(found) > 0, folded).otherwise(F.array().cast(kind))


def _battery(tokens: Column) -> Column:
    """array<struct<s, e, p, w>>: each token's p-value at weight ``_UNIT`` and its weight w; p is 1 where the battery rules it out."""

    def encoding(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, (pattern, _) in reversed(ENCODINGS.items()):
            out = F.when(t.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    def located(t: Column, alphabet: str) -> Column:
        return F.transform(F.split(t, "(?!$)"), lambda x: F.instr(F.lit(alphabet), x))

    def places(c: Column) -> Column:
        out = F.lit(None).cast("array<int>")
        for name, (_, alphabet) in ENCODINGS.items():
            out = F.when(c["k"] == name, located(F.lower(c["t"]) if name == "base36" else c["t"], alphabet)).otherwise(out)
        return out

    def kinds(t: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a")
        return F.length(F.regexp_replace(plain, "[^0-9A-Za-z]+", "-")) - 1

    typed = F.filter(
        F.transform(tokens, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["t"].alias("t"), encoding(c["t"]).alias("k"))),
        lambda c: c["k"].isNotNull(),
    )
    placed = F.transform(
        typed,
        lambda c: F.struct(
            c["s"].alias("s"),
            c["e"].alias("e"),
            c["k"].alias("k"),
            F.length(c["t"]).cast("double").alias("n"),
            kinds(c["t"]).cast("double").alias("changes"),
            places(c).alias("v"),
        ),
    )
    zero = F.lit(0.0)
    summed = F.transform(
        placed,
        lambda c: F.struct(
            c["s"].alias("s"),
            c["e"].alias("e"),
            c["n"].alias("n"),
            c["changes"].alias("changes"),
            _by_encoding(c["k"], len).alias("m"),
            _by_encoding(c["k"], _change_rate).alias("rate"),
            F.aggregate(
                F.array_distinct(c["v"]),
                zero,
                lambda a, x: a + F.pow(c["n"] - F.size(F.array_remove(c["v"], x)), F.lit(2.0)),
            ).alias("squares"),
            F.aggregate(c["v"], zero, lambda a, x: a + x).alias("s1"),
            F.aggregate(c["v"], zero, lambda a, x: a + x * x).alias("s2"),
            F.aggregate(
                F.zip_with(F.slice(c["v"], 1, F.size(c["v"]) - 1), F.slice(c["v"], 2, F.size(c["v"]) - 1), lambda a, b: a * b),
                zero,
                lambda a, x: a + x,
            ).alias("lag"),
            (F.element_at(c["v"], 1) * F.element_at(c["v"], -1)).cast("double").alias("ends"),
        ),
    )

    def p_value(c: Column) -> Column:
        n, m = c["n"], c["m"]
        chi2 = m / n * c["squares"] - n
        chance = _upper_tail((F.cbrt(chi2 / (m - 1)) - (1 - 2 / (9 * (m - 1)))) / F.sqrt(2 / (9 * (m - 1))))
        runs = 2 * _upper_tail(F.abs(c["changes"] - (n - 1) * c["rate"]) / F.sqrt((n - 1) * c["rate"] * (1 - c["rate"])))
        spread = c["s2"] - c["s1"] * c["s1"] / n
        serial = F.when(spread > 0, (c["lag"] + c["ends"] - c["s1"] * c["s1"] / n) / spread).otherwise(F.lit(1.0))
        apart = 2 * _upper_tail(F.abs(serial + 1 / (n - 1)) * F.sqrt(n))
        excess = F.greatest(m * _TEXT_SQUARES - 1, F.lit(0.25)) * (n - 1)
        as_text = _upper_tail((m - 1 + excess - chi2) / F.sqrt(2 * (m - 1) + 4 * excess))
        as_runs = _upper_tail((c["changes"] - (n - 1) * _TEXT_CHANGES - 0.5) / F.sqrt((n - 1) * _TEXT_CHANGES * (1 - _TEXT_CHANGES)))
        fit = (chance >= GATE) & (runs >= GATE) & (apart >= GATE)
        # weight: a token's share of the error grows with its length
        return F.when(fit, F.least(F.lit(1.0), F.greatest(as_text, as_runs) * _UNIT / F.least(n, F.lit(float(_LONGEST))))).otherwise(F.lit(1.0))

    return F.transform(summed, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), p_value(c).alias("p"), F.least(c["n"], F.lit(float(_LONGEST))).cast("long").alias("w")))


def false_discovery_threshold(counts: dict[int, int], alpha: float, weight: float | None = None) -> float:
    """The largest p-value to accept, from the number of p-values in each bin.

    Bin b holds p <= 10 ** (-b / _STEPS); a bin is accepted whole, by its upper end, so the
    bound on false finds holds as for sorted p-values. ``weight`` is the sum of the weights that
    the p-values were divided by; without it each has weight 1.
    """
    total, seen, best = sum(counts.values()) if weight is None else weight, 0, 0.0
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        upper = 10.0 ** (-b / _STEPS)
        if upper * total <= alpha * seen:
            best = upper
    return best


def find_secrets(docs: DataFrame, alpha: float = 0.01, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, found), one for each row of ``docs``; found is array<struct<s, e, k, o>>.

    s and e are code points, end exclusive; k is assign, access, hex or random; o orders kinds
    at one start. Kinds of ``BASE`` are found leftmost and non-overlapping per kind, and a match
    that is too short is used up. ``random`` spans come from the battery and never overlap
    another kind's. ``carry`` names further columns of ``docs`` to keep.

    Defined cases: a null text is empty and has no span; ids may be null or repeated, as each
    row is handled alone; an empty table gives an empty table; other columns are left unread.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("__text"), *[F.col(c).alias(f"__c_{c}") for c in carry])
    whole = F.col("__text")
    matched = read.select(
        "*",
        *[F.regexp_extract_all(whole, F.lit(p), F.lit(0)).alias(f"__m_{k}") for k, (p, _, _) in BASE.items()],
        F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)).alias("__m_token"),
    )
    placed = matched.select(
        "doc_id",
        *[f"__c_{c}" for c in carry],
        *[spans(whole, p, F.col(f"__m_{k}")).alias(f"__{k}") for k, (p, _, _) in BASE.items()],
        spans(whole, TOKEN, F.col("__m_token")).alias("__token"),
    )
    def of_kind(o: int, k: str) -> Column:
        pattern, group, least = BASE[k]
        long = lambda c: F.length(F.regexp_extract(c["t"], pattern, group) if group else c["t"]) >= least
        kept = F.filter(F.col(f"__{k}"), long)
        return F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(k).alias("k"), F.lit(o).alias("o")))

    base = [of_kind(o, k) for o, k in enumerate(BASE)]
    scanned = written(
        placed.select("doc_id", *[f"__c_{c}" for c in carry], F.concat(*base).alias("base"), F.col("__token"))
        .select(
            "doc_id",
            *[f"__c_{c}" for c in carry],
            "base",
            F.filter("__token", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))).alias("__token"),
        )
        .select("doc_id", *[F.col(f"__c_{c}").alias(c) for c in carry], "base", _battery(F.col("__token")).alias("tested")),
        "secrets",
    )
    power = F.floor(-F.log10(F.greatest(F.col("t.p"), F.lit(10.0**-_POWERS))) * _STEPS).cast("int")
    bins = scanned.select(F.explode("tested").alias("t")).groupBy(power.alias("b")).agg(F.count("*").alias("n"), F.sum("t.w").alias("w")).collect()  # at most _STEPS * _POWERS + 1 rows
    limit = false_discovery_threshold({r["b"]: r["n"] for r in bins}, alpha, sum(r["w"] for r in bins) / _UNIT)
    random = F.transform(
        F.filter("tested", lambda c: c["p"] <= F.lit(limit)),
        lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit("random").alias("k"), F.lit(len(BASE)).alias("o")),
    )
    ordered = F.array_sort(F.transform(F.concat("base", random), lambda c: F.struct(c["s"].alias("s"), c["o"].alias("o"), c["e"].alias("e"), c["k"].alias("k"))))
    return scanned.select("doc_id", *carry, ordered.alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["k"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    folded = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, c: F.struct(
            F.greatest(a["at"], c["e"]).alias("at"),
            F.when(c["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, c["s"] - a["at"]), F.lit(mask))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text) - a["at"])),
    )
    return F.when(F.size(found) > 0, folded).otherwise(text)


def masked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the secrets of each text masked and ``length_col`` counted again; nulls stay null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    found = find_secrets(docs.select(id_col, text_col, row), id_col=id_col, text_col=text_col, carry=("__row",), **options)
    clean = found.select(masked(F.col(f"__row.`{text_col}`"), F.col("found")).alias("__clean"), "__row")
    changed = {text_col: F.col("__clean"), length_col: F.length("__clean").cast("long")}
    return clean.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
