"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's score is a logistic function of its words and their beginnings; a document is toxic
with the noisy-or of its sentences, 1 - prod(1 - score). Weights are trained from document labels
alone, through the noisy-or, so they also say which sentences offend. Features are chosen by an
aggregation over the labelled documents, and the labelled rows that weights are trained on are
bounded; everything else runs a batch at a time over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, text_slices
from .words import as_large, string_hashes

#: Lengths of a longer word's beginnings that count as features, beside the word itself.
BEGINNINGS = (4, 5, 6, 7)
SENTENCE_END = r"[.!?\n]+"
NOT_LETTERS = r"[^\p{L}\p{M}]+"


@dataclass
class Sentences:
    """Words of a batch in sentences: word ``i`` is ``codes[i]`` of ``words``, in sentence ``of[i]``."""

    words: pa.Array
    codes: np.ndarray
    of: np.ndarray
    text_of: np.ndarray  # the text of each sentence; sentences without a word have no row in ``of``


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    ends = lists.offsets.to_numpy()
    return lists.values.slice(ends[0], ends[-1] - ends[0]), np.repeat(np.arange(len(lists)), np.diff(ends))


def split_sentences(texts: pa.Array) -> Sentences:
    """Lower-cased words of letters, by sentence; a null text has none."""
    sentences, text_of = _flat(pc.split_pattern_regex(pc.utf8_lower(as_large(texts)), SENTENCE_END))
    words, of = _flat(pc.split_pattern_regex(sentences, NOT_LETTERS))
    full = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    return Sentences(coded.dictionary, coded.indices.to_numpy().astype(np.int64), of[full.to_numpy(zero_copy_only=False)], text_of)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs: hashes of each word and of its beginnings."""
    length = pc.utf8_length(words).to_numpy()
    who, what = [np.arange(len(words))], [string_hashes(words)]
    for n in BEGINNINGS:
        at = np.flatnonzero(length > n)
        who.append(at)
        with np.errstate(over="ignore"):  # the seed's product wraps
            what.append(string_hashes(pc.utf8_slice_codeunits(words.take(pa.array(at)), 0, n), seed=n))
    return np.concatenate(who), np.concatenate(what).view(np.int64)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Indexes of one row for each combination, in their order."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order[new]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (feature, clean, toxic): in how many texts of a slice each feature is."""
    for part in text_slices(batches, "text"):
        found, label = split_sentences(part.column("text")), part.column("toxic").to_numpy()
        text = found.text_of[found.of]
        one = _firsts(text, found.codes)
        text, codes = text[one], found.codes[one]
        word, feature = word_features(found.words)
        # every pair (text, feature) once
        seen, code = np.unique(feature, return_inverse=True)
        order = np.argsort(word, kind="stable")
        count = np.bincount(word, minlength=len(found.words))
        begin = np.cumsum(count) - count
        n = count[codes]
        at = np.repeat(begin[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner, which = np.repeat(text, n), code[order][at]
        once = _firsts(owner, which)
        y = label[owner[once]]
        toxic = np.bincount(which[once], y, minlength=len(seen)).astype(np.int64)
        total = np.bincount(which[once], minlength=len(seen)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total - toxic), pa.array(toxic)], ["feature", "clean", "toxic"])


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def word_weights(self, words: pa.Array) -> np.ndarray:
        """The sum of the weights of each word's features."""
        word, feature = word_features(words)
        place = np.searchsorted(self.features, feature)
        hit = np.flatnonzero(self.features[np.minimum(place, len(self.features) - 1)] == feature) if len(self.features) else np.zeros(0, np.int64)
        return np.bincount(word[hit], self.weights[place[hit]], minlength=len(words))

    def sentence_logits(self, found: Sentences) -> np.ndarray:
        """A logit for each sentence; each distinct word of a sentence counts once."""
        weight = self.word_weights(found.words)
        some = np.flatnonzero(weight[found.codes] != 0)
        of, codes = found.of[some], found.codes[some]
        one = _firsts(of, codes)
        return self.bias + np.bincount(of[one], weight[codes[one]], minlength=len(found.text_of))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _bags(features: np.ndarray):
    """Rows (toxic, h, n_other, lengths, found) of labelled texts: the features of each sentence that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            found = split_sentences(part.column("text"))
            word, feature = word_features(found.words)
            place = np.searchsorted(features, feature)
            hit = np.flatnonzero(features[np.minimum(place, len(features) - 1)] == feature)
            order = np.argsort(word[hit], kind="stable")
            listed = place[hit][order]
            count = np.bincount(word[hit], minlength=len(found.words))
            begin = np.cumsum(count) - count
            some = np.flatnonzero(count[found.codes] > 0)
            of, codes = found.of[some], found.codes[some]
            one = _firsts(of, codes)
            of, codes = of[one], codes[one]
            n = count[codes]
            at = np.repeat(begin[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sentence, entry = np.repeat(of, n), listed[at]
            used, length = np.unique(sentence, return_counts=True)
            of_text = found.text_of[used]
            rows = part.num_rows
            per_text = np.bincount(of_text, minlength=rows)
            entries = np.bincount(of_text, length, minlength=rows).astype(np.int64)
            other = np.bincount(found.text_of, minlength=rows) - per_text
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends)]), pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), part.column("h"), pa.array(other, pa.int64()), lists(per_text, length), lists(entries, entry)],
                ["toxic", "h", "n_other", "lengths", "found"],
            )

    return run


def train(y: np.ndarray, other: np.ndarray, bag_of: np.ndarray, sentence_of: np.ndarray, entry: np.ndarray, width: int, steps: int = 400, rate: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of least noisy-or log loss.

    ``bag_of`` has the bag of each sentence that has features, ``sentence_of`` and ``entry`` a
    row for each feature of a sentence, ``other`` how many sentences without features a bag has.
    With a = sum(softplus(z)), a bag is clean with exp(-a); the loss is a for clean bags and
    -log(1 - exp(-a)) for toxic ones. Adam on all bags at once, so that reruns agree.
    """
    w, bags, n = np.zeros(width + 1), len(y), len(bag_of)
    w[-1] = -6.0
    mean, var = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(sentence_of, w[entry], minlength=n)
        a = np.bincount(bag_of, _softplus(z), minlength=bags) + other * _softplus(w[-1])
        slope = np.where(y == 1, -1 / np.expm1(np.clip(a, 1e-9, 500.0)), 1.0) / bags
        push = slope[bag_of] / (1 + np.exp(-z))
        grad = np.empty(width + 1)
        grad[:-1] = np.bincount(entry, push[sentence_of], minlength=width) + penalty * w[:-1]
        grad[-1] = push.sum() + (slope * other).sum() / (1 + np.exp(-w[-1]))
        mean = 0.9 * mean + 0.1 * grad
        var = 0.999 * var + 0.001 * grad**2
        w -= rate * min(1.0, 4 * (1 - step / (steps + 1))) * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def chosen(labels: DataFrame, most_rows: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Rows (doc_id, toxic) to learn from, one for each id: about ``most_rows``, those of smallest hash.

    Left out are ids whose crc32 as text leaves 2 modulo 4, which are held out, labels other
    than 0 and 1, and ids with contradicting labels.
    """
    i = F.col(id_col).cast("long")
    known = labels.where(i.isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(i.cast("string")) % 4 != 2)).groupBy(i.alias("doc_id"))
    known = known.agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = hi").select("doc_id", F.col("lo").cast("long").alias("toxic"))
    share = min(1.0, most_rows / max(1, known.count()))
    return known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11) < int(share * 2**53))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_entries: int = 8_000_000, most_features: int = 512, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labelled documents.

    Bounds: about ``most_rows`` labelled ids, and of the documents that carry them, each
    distinct one once, at most ``most_rows``, with about ``most_entries`` features together;
    all by smallest hash, each with its whole text. Features are the ``most_features`` whose
    shares in toxic and in clean documents differ most for their standard error.
    """
    ids = F.broadcast(chosen(labels, most_rows))  # bounded; texts stay where they are
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = small_batches(plain.join(ids, "doc_id")).select("toxic", F.xxhash64("doc_id", "text").alias("h"), "text")
    tally = sample.mapInArrow(_tally, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    sizes = plain.select("doc_id").join(ids, "doc_id").agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t")).first()
    if not sizes["c"] or not sizes["t"]:
        return Model(np.zeros(0, np.int64), np.zeros(0), -12.0)
    odds = lambda k, n: f"(ln({k} + 0.5D) - ln({n} - {k} + 0.5D))"
    error = "sqrt(1 / (t + 0.5D) + 1 / (c + 0.5D))"
    z = F.expr(f"({odds('t', sizes['t'])} - {odds('c', sizes['c'])}) / {error}")
    best = tally.where("c + t >= 3").select("feature", F.abs(z).alias("z")).where("z >= 2").orderBy(F.desc("z"), "feature").limit(most_features)
    features = np.sort(np.array([r["feature"] for r in best.collect()], np.int64))
    if not len(features):
        return Model(features, np.zeros(0), -12.0)
    bags = sample.mapInArrow(_bags(features), "toxic long, h long, n_other long, lengths array<int>, found array<int>")
    bags = bags.groupBy("h", "toxic").agg(*[F.first(c).alias(c) for c in ("n_other", "lengths", "found")])
    entries = bags.agg(F.sum(F.size("found"))).first()[0] or 0
    share = min(1.0, most_entries / max(1, entries))
    some = bags.where(F.shiftrightunsigned(F.xxhash64("h"), 11) < int(share * 2**53)).orderBy("h", "toxic").limit(most_rows).toArrow().combine_chunks()
    size = lambda c: pc.list_value_length(some.column(c)).to_numpy()
    flat = lambda c: pc.list_flatten(some.column(c)).to_numpy().astype(np.int64)
    lengths = flat("lengths")
    weights, bias = train(
        some.column("toxic").to_numpy(),
        some.column("n_other").to_numpy(),
        np.repeat(np.arange(some.num_rows), size("lengths")),
        np.repeat(np.arange(len(lengths)), lengths),
        flat("found"),
        len(features),
    )
    return Model(features, weights, bias)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            found = split_sentences(part.column("__text"))
            worded = np.zeros(len(found.text_of), bool)
            worded[found.of] = True
            clean = np.bincount(found.text_of[worded], _softplus(model.sentence_logits(found)[worded]), minlength=part.num_rows)
            kept = [part.column(i) for i, f in enumerate(part.schema) if f.name != "__text"]
            names = [f.name for f in part.schema if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(-np.expm1(-clean))], [*names, "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each row of ``docs``: the noisy-or of its sentences.

    Defined cases: a text that is null, empty or without letters has no sentence and scores 0;
    a text is read whole, whatever its length; repeated ids are scored row by row; an empty
    table gives an empty table; other columns are ignored under any name.
    """
    read = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    return read.mapInArrow(_score(model), "doc_id long, score double")


def _locate(model: Model, least: float):
    cut = -np.inf if least <= 0 else np.inf if least >= 1 else float(np.log(least / (1 - least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            found = split_sentences(part.column("text"))
            logits = model.sentence_logits(found)
            worded = np.zeros(len(logits), bool)
            worded[found.of] = True
            hits = np.flatnonzero(worded & (logits >= cut))
            texts = as_large(part.column("text"))
            first = np.searchsorted(found.text_of, np.arange(part.num_rows))
            out: list[tuple] = []
            for t in np.unique(found.text_of[hits]).tolist():
                # the same cuts in the text as it is: none of the marks changes by lower-casing
                text = texts[t].as_py()
                pieces = pc.split_pattern_regex(pa.array([text], pa.large_string()), SENTENCE_END).values.to_pylist()
                starts, at = [], 0
                for piece in pieces:
                    at = text.index(piece, at)
                    starts.append(at)
                    at += len(piece)
                    while at < len(text) and text[at] in ".!?\n":
                        at += 1
                for s in hits[found.text_of[hits] == t].tolist():
                    k = s - int(first[t])
                    out.append((part.column("doc_id")[t].as_py(), starts[k], starts[k] + len(pieces[k]), pieces[k], float(1 / (1 + np.exp(-logits[s])))))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "start", "end", "sentence", "score"])

    return run


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, sentence, score) of the sentences that score ``least`` or more.

    Offsets are in code points, end exclusive; null and empty texts have no sentence.
    """
    read = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(_locate(model, least), "doc_id long, start long, end long, sentence string, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    The model is fitted on the labelled documents outside the held-out ids (``fit`` states its
    bounds); edge cases are those of ``score``. A row without an id is not held out. Without
    toxic or without clean labels to learn from every score is next to 0.
    """
    scored = score(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **bounds), id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
