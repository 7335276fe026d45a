"""Quality rules: text statistics, and a decision list learned from labelled documents.

Statistics are counted on whole texts, a batch at a time. Sequential covering grows rules on
part of the labelled rows, one threshold condition at a time by information gain, prunes each
on the rest and removes what it covers. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, text_slices, written
from .words import as_large, mix64, split_words, window_hashes, word_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct")

#: Statistics that conditions test, as SQL over the counts; none is a length, which says little of quality.
STATISTICS = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(sqrt(n_words), 1)",
}


def _per_text(of: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, weight, minlength=n).astype(np.int64)


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow array."""
    texts = as_large(texts)
    n = len(texts)
    batch = split_words(texts)
    of = batch.text_of
    hashes = word_hashes(batch)
    repeat = np.zeros(len(of), bool)
    if len(of) > 2:
        inside = of[2:] == of[:-2]
        keys = mix64(window_hashes(hashes, 3) + mix64(of[:-2].astype(np.uint64)))[inside]
        _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        start = np.flatnonzero(inside)[times[back] > 1]
        for k in range(3):
            repeat[start + k] = True
    own = _distinct(of, hashes)
    lines = pc.split_pattern(texts, "\n")
    flat = lines.values.slice(lines.offsets[0].as_py(), lines.offsets[-1].as_py() - lines.offsets[0].as_py())
    line_of = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    some, code = line_of[full], codes[full]
    distinct_lines = np.unique(some * (int(codes.max(initial=0)) + 1) + code) // (int(codes.max(initial=0)) + 1)
    with_word = _per_text(some, n)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy().astype(np.int64)
    return {
        "n_words": batch.counts.astype(np.int64),
        "word_chars": _per_text(of, n, pc.utf8_length(batch.words).to_numpy()),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": with_word - _per_text(distinct_lines, n),
        "n_repeat_words": _per_text(of[repeat], n),
        "n_lines": with_word,
        "n_upper": count(r"\p{Lu}"),
        "n_marks": count(r"[!?]"),
        "n_digits": count(r"[0-9]"),
        "n_distinct": own,
    }


def _distinct(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many different words each text has."""
    n = int(of.max()) + 1 if len(of) else 0
    order = np.lexsort((hashes, of))
    first = np.ones(len(of), bool)
    first[1:] = (of[order][1:] != of[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    return _per_text(of[order][first], n)


def _count_beside(column: str):
    """All columns as they are, and the counts of one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, column):
            counts = text_counts(part.column(column))
            added = [pa.array(np.pad(counts[c], (0, part.num_rows - len(counts[c]))), pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *COUNTS])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "__text"):
        counts = text_counts(part.column("__text"))
        kept = [part.column(i) for i, f in enumerate(part.schema) if f.name != "__text"]
        names = [f.name for f in part.schema if f.name != "__text"]
        n = part.num_rows
        columns = [pa.array(np.pad(counts[c], (0, n - len(counts[c]))), pa.int64()) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([*kept, *columns], [*names, *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, ``COUNTS``), one for each row of ``docs``; a null text has no words."""
    read = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in carry], F.col(text_col).alias("__text"))
    kept = [f for f in read.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} long" for c in COUNTS])
    return read.mapInArrow(_count, schema)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] >= self.threshold if self.above else table[self.name] < self.threshold

    def sql(self) -> str:
        return f"{STATISTICS[self.name]} {'>=' if self.above else '<'} {self.threshold!r}D"


def _covered(rule: list[Condition], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _candidates(values: np.ndarray, most: int = 48) -> np.ndarray:
    """Thresholds halfway between neighbouring values, at most so many, at even ranks."""
    seen = np.unique(values)
    middle = (seen[1:] + seen[:-1]) / 2
    return middle if len(middle) <= most else middle[np.linspace(0, len(middle) - 1, most).astype(int)]


def grow(table: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> list[Condition]:
    """Adds the condition of greatest gain until no good row is covered."""
    n, rule = len(bad), []
    inside = np.ones(n, bool)
    while len(rule) < most and (inside & ~bad).any() and (inside & bad).any():
        p, q = (inside & bad).sum(), (inside & ~bad).sum()
        best = (0.0, None, None)
        for name, values in table.items():
            for t in _candidates(values[inside]):
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    now = inside & c.holds(table)
                    a, b = (now & bad).sum(), (now & ~bad).sum()
                    gain = a * (log2(a / (a + b)) - log2(p / (p + q))) if a else 0.0
                    if gain > best[0] + 1e-12:
                        best = (gain, c, now)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return rule


def prune(rule: list[Condition], table: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """The rule's beginnings, best first by (bad - good) / covered on held-back rows, then shorter."""

    def worth(r: list[Condition]) -> float:
        inside = _covered(r, table, len(bad))
        p, q = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - q) / (p + q) if p + q else -1.0

    return sorted((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (-worth(r), len(r)))


def learn(table: dict[str, np.ndarray], bad: np.ndarray, split: np.ndarray, precision: float = 0.95, least: int = 2, most: int = 12) -> list[list[Condition]]:
    """An ordered list of conjunctions that single out bad rows; ``split`` marks the rows to grow on.

    A rule counts if, of all rows it covers, at least ``precision`` are bad and at least
    ``least`` are; of its beginnings the best that does is taken, and if none does the list ends.
    """
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < most:
        take = lambda keep: {k: v[keep] for k, v in table.items()}
        on, back = left & split, left & ~split
        if not (bad & on).any():
            break
        for rule in prune(grow(take(on), bad[on]), take(back), bad[back]):
            inside = left & _covered(rule, table, len(bad))
            if (inside & bad).sum() >= max(least, precision * inside.sum()):
                break
        else:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """False for rows that a rule rejects: the list as one CASE, its rules in order."""
    if not rules:
        return F.lit(True)
    whens = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in rules)
    return F.expr(f"CASE {whens} ELSE true END")


def chosen(labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """Rows (doc_id, quality) that a list is fitted on, one for each id.

    Bound: about ``most_rows``, those with the smallest hashes; the share that may go is set
    before, so that tasks send no more than they keep. Labels other than 0 and 1 and ids with
    contradicting labels are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi").select("doc_id", F.col("lo").alias("quality"))
    share = min(1.0, most_rows / max(1, known.count()))
    return known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) < int(share * 2**53))


def fit(counts: DataFrame, labelled: DataFrame, most_rows: int = 20_000) -> list[list[Condition]]:
    """Learns the list from the counts of the ``chosen`` rows, which are broadcast.

    Bound: at most twice ``most_rows`` rows reach the driver, whatever ids repeat: of an id's
    rows those with equal statistics count once, and of all the ones with the smallest hashes stay.
    """
    named = [F.expr(f"CAST({x} AS DOUBLE)").alias(k) for k, x in STATISTICS.items()]
    known = counts.join(F.broadcast(labelled), "doc_id").where("n_words > 0").select("quality", F.xxhash64("doc_id", F.lit(5)).alias("h"), *named).distinct()
    rows = known.orderBy(F.xxhash64("h", *STATISTICS), "h", "quality", *STATISTICS).limit(2 * most_rows).toPandas()
    rows = rows.sort_values(["h", *STATISTICS], ignore_index=True)
    if rows.empty:
        return []
    table = {k: rows[k].to_numpy() for k in STATISTICS}
    return learn(table, rows["quality"].to_numpy() == 0, rows["h"].to_numpy() % 3 != 0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, counts, base_failed, kept), one for each row of ``docs``.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows.
    kept: the learned list's verdict for rows that pass this base.

    Defined cases: a null or empty text has no words and fails the base; repeated ids are
    judged row by row; without usable labels the list is empty; an empty table gives an empty
    table; further columns are ignored.
    """
    counts = written(statistics(docs, id_col, text_col, carry), "counts")
    rules = fit(counts, chosen(labels))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return counts.select("*", failed.alias("base_failed")).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the learned list or the repeat rule rejects.

    Unlike the base of ``judge`` this has no least length: labels don't hold one against short
    texts. Rows, columns and their order of columns stay as they are; edge cases are as there.
    """
    labelled = chosen(labels)
    ids = F.broadcast(labelled.select(F.col("doc_id").alias("__label")))  # bounded; texts stay where they are
    sample = docs.join(ids, docs[id_col].cast("long") == ids["__label"], "left_semi")
    rules = fit(statistics(sample, id_col, text_col), labelled)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column's name clashes with a count's
    plain = small_batches(docs).toDF(*names)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields] + [f"{c} long" for c in COUNTS])
    counted = plain.mapInArrow(_count_beside(names[docs.columns.index(text_col)]), schema)
    kept = counted.where(verdict(rules) & F.expr("NOT 100 * n_repeat_words > 50 * n_words"))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
