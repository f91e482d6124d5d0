"""Subject areas of documents, by weighted subject terms matched with an automaton.

The terms are curated by rule from the seed terms of the subject table and a bounded sample of
labelled documents: in rounds, sentences are given to the subject whose terms they hold, and words
that keep company with one subject far above its share become its terms. Each term has a weight a
subject (log of its lift) and a rarity over all documents. A multi-pattern automaton then finds the
terms in every text; each sentence of prose goes to the subject with the highest normalised score
above a threshold, and a document has each subject that holds a fifth of its sentences.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize

#: Labelled documents that the terms are learnt from, at most. Their texts are read whole.
LABELLED_ROWS = 4_000
#: Rounds of learning; least sentences with a term; least share and lift of a subject among them.
ROUNDS, LEAST_SENTENCES, LEAST_SHARE, LEAST_LIFT = 6, 3, 0.3, 2.0
#: What a label counts for a sentence without known terms, of 1.
HINT = 0.3
#: Share of a document's prose sentences that makes it be about a subject.
DOCUMENT_SHARE = 0.2
#: A sentence's least score is this times the score that all but a twentieth of a subject's sentences in documents of its label reach.
CALIBRATION = 0.5

_FENCE = re.compile(r"^\s*(```|~~~)")
_ITEM = re.compile(r"^\s*(?:[-*+•]\s|\d+[.)]\s|#{1,6}\s|\||>|\$)")
_SENTENCE = re.compile(r"[^.!?…]*(?:[.!?…](?![\s\"'”’»)\]*]|$)[^.!?…]*)*[.!?…]+[\"'”’»)\]*]*(?=\s|$)")
_LINES = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85  ]")
_WORDS = re.compile(r"[^\W\d_]+")
_HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


def sentences(text: str) -> list[list[str]]:
    """Words of each prose sentence, in lower case. Fenced code, headings, lists, tables and formulas hold none.

    A line that doesn't end like a sentence is a heading or residue, but for the sentences inside it.
    """
    found, fence = [], None
    for line in _LINES.split(unicodedata.normalize("NFKC", text).translate(_HIDDEN)):
        mark = _FENCE.match(line)
        if mark:
            fence = None if fence == mark[1] else fence or mark[1]
            continue
        if fence or _ITEM.match(line):
            continue
        for s in _SENTENCE.findall(line):
            words = _WORDS.findall(s.lower())
            if words:
                found.append(words)
    return found


def score(words: list[str], weights: dict[str, list[tuple[str, float]]], rarity: dict[str, float]) -> tuple[str | None, float]:
    """The subject with the highest sum of weight times rarity, divided by the root of the words, if it leads."""
    sums: dict[str, float] = defaultdict(float)
    for w in words:
        for s, x in weights.get(w, ()):
            sums[s] += x * rarity.get(w, 1.0)
    if not sums:
        return None, 0.0
    (best, top), *rest = sorted(sums.items(), key=lambda p: (-p[1], p[0]))[:2]
    second = rest[0][1] if rest else 0.0
    return (best if top > second else None), top / math.sqrt(len(words))


def _needed(usual: float) -> float:
    """The lift asked for: ``LEAST_LIFT``, or half way to the most that a frequent subject can have."""
    return min(LEAST_LIFT, (1 + 1 / usual) / 2)


def learn(sample: list[tuple[str, list[str]]], seeds: dict[str, list[str]], rounds: int = ROUNDS) -> dict[str, list[tuple[str, float]]]:
    """Terms, each with its (subject, weight) pairs, from (text, subjects given by hand) pairs and the seed terms of each subject.

    Labels are incomplete and sometimes wrong. They are a weak hint for sentences without known terms, and
    a check: a term of a subject must stand in documents of that label well above the label's share,
    which turns of phrase that all subjects use never do.
    """
    weights: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for s, terms in seeds.items():
        for t in terms:
            for w in _WORDS.findall(unicodedata.normalize("NFKC", t).lower()):
                weights[w].append((s, math.log(max(2, len(seeds)))))
    fixed = {w: p for w, p in weights.items()}
    units = [(sorted(set(words)), labels) for text, labels in sample for words in sentences(text)]
    by_label: dict[str, Counter] = defaultdict(Counter)  # in how many sentences of documents with a label a word stands
    base: Counter = Counter()
    for words, labels in units:
        for x in labels:
            base[x] += 1
            for w in words:
                by_label[w][x] += 1
    seen = Counter(w for words, _ in units for w in words)
    for _ in range(rounds):
        by_word: dict[str, Counter] = defaultdict(Counter)
        total: Counter = Counter()
        for words, labels in units:
            best, _ = score(words, weights, {})
            given = {best: 1.0} if best is not None else {labels[0]: HINT} if len(labels) == 1 else {}
            for x, v in given.items():
                total[x] += v
                for w in words:
                    by_word[w][x] += v
        everything = sum(total.values()) or 1.0
        weights = {}
        for w, c in by_word.items():
            n = seen[w]
            if n < LEAST_SENTENCES:
                continue
            pairs = []
            for x, v in c.items():
                share, usual = v / (n + 0.5), total[x] / everything
                common = max(base[x], 1) / len(units)
                labelled = (by_label[w][x] + base[x] / len(units)) / (n + 1) / common
                if share >= LEAST_SHARE and share / usual >= _needed(usual) and labelled >= _needed(common):
                    pairs.append((x, math.log(share / usual)))
            if pairs:
                weights[w] = sorted(pairs)
        for w, pairs in fixed.items():
            weights.setdefault(w, pairs)
    return dict(weights)


def calibrate(sample: list[tuple[str, list[str]]], weights: dict[str, list[tuple[str, float]]], rarity: dict[str, float]) -> dict[str, float]:
    """Least score of a sentence for each subject, from the sentences of documents with the subject's label."""
    scores: dict[str, list[float]] = defaultdict(list)
    for text, labels in sample:
        for words in sentences(text):
            best, x = score(sorted(set(words)), weights, rarity)
            if best in labels:
                scores[best].append(x)
    return {s: CALIBRATION * sorted(x)[len(x) // 20] for s, x in scores.items()}


class Matcher:
    """Automaton over all terms; gives the distinct terms of a sentence."""

    def __init__(self, terms) -> None:
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for t in terms:
            self._automaton.add_word(f" {t} ", t)
        self._automaton.make_automaton()
        self._any = len(self._automaton) > 0

    def terms(self, words: list[str]) -> list[str]:
        return sorted({t for _, t in self._automaton.iter(f" {' '.join(words)} ")}) if self._any else []


def belongs(terms: list[int], size: int, weights: list[list[tuple[str, float]]], least: dict[str, float]) -> str | None:
    """The subject of a sentence with these terms and this many different words, if one leads and passes its threshold."""
    sums: dict[str, float] = defaultdict(float)
    for t in terms:
        for s, x in weights[t]:
            sums[s] += x
    ranked = sorted(sums.items(), key=lambda p: (-p[1], p[0]))
    s, top = ranked[0]
    return s if (len(ranked) == 1 or top > ranked[1][1]) and top / math.sqrt(size) >= least.get(s, 0.0) else None


def labelled_sample(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rows: int) -> list[tuple[str, list[str]]]:
    """(text, subjects) of at most ``rows`` labelled documents, chosen by hash, one row a doc_id (its smallest text).

    Case and blanks of labels don't count, unknown ones neither.
    """
    known = subjects.select(F.col("subject"), F.lower(F.trim("subject")).alias("_s")).where("_s IS NOT NULL").distinct()
    named = labels.select("doc_id", F.lower(F.trim("subject")).alias("_s")).where("doc_id IS NOT NULL").join(known, "_s").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("labels"))
    present = named.join(documents.select("doc_id").where(F.length("text") > 0), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(rows)
    texts = documents.select("doc_id", "text").where(F.length("text") > 0).join(chosen, "doc_id")
    found = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("labels").alias("labels")).toArrow().to_pylist()
    return [(r["text"], r["labels"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]


def subject_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, subject, share: the part of each document's prose sentences that belongs to a subject, where it is above 0.

    Null, empty and blank texts and texts without prose give no rows. Repeated rows give repeated rows. A
    text's result depends on its words alone, so copies agree. An empty subject table gives no rows;
    without labels the seed terms alone are used. Only the labelled sample reaches the driver; term
    rarity is counted over all documents, and texts are matched whole.
    """
    spark = documents.sparkSession
    seeds = {r["subject"]: r["seed_terms"] or [] for r in subjects.where("subject IS NOT NULL").select("subject", "seed_terms").collect()}  # one row a subject area
    sample = labelled_sample(documents, labels, subjects, labelled_rows)
    weights = learn(sample, seeds)
    terms = sorted(weights)
    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def find(batches):
        matcher, number = Matcher(terms), {t: i for i, t in enumerate(terms)}
        ints = pa.list_(pa.int32())
        for batch in batches:
            totals, sizes, found = [], [], []
            for text in batch.column(1).to_pylist():
                units = sentences(text)
                hits = [(len(set(words)), [number[t] for t in got]) for words in units if (got := matcher.terms(words))]
                totals.append(len(units))
                sizes.append([n for n, _ in hits])
                found.append([t for _, t in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int32()), pa.array(sizes, ints), pa.array(found, pa.list_(ints))], names=["doc_id", "n", "sizes", "terms"])

    # the one pass over the texts: the sentences that hold terms, as numbers
    matched = materialize(texts.mapInArrow(find, f"doc_id {kind}, n int, sizes array<int>, terms array<array<int>>"), "matched")
    counted = matched.select(F.explode(F.array_distinct(F.flatten("terms"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row a term
    df, n = {r["term"]: r["n"] for r in counted}, matched.count()
    idf = [math.log((n + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(terms))]
    mean = sum(idf) / len(idf) if idf else 1.0
    rarity = {t: math.sqrt(x / mean) for t, x in zip(terms, idf)}
    least = calibrate(sample, weights, rarity)
    weighted = [[(s, x * rarity[t]) for s, x in weights[t]] for t in terms]
    model = spark.sparkContext.broadcast((weighted, least))  # bounded by the learning sample

    def assign(batches):
        weighted, least = model.value
        for batch in batches:
            rows, names, parts = [], [], []
            for i, (n, sizes, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                counts = Counter(s for size, t in zip(sizes, found) if (s := belongs(t, size, weighted, least)) is not None)
                for s, x in sorted(counts.items()):
                    rows.append(i)
                    names.append(s)
                    parts.append(x / n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(parts, pa.float64())], names=["doc_id", "subject", "share"])

    return matched.mapInArrow(assign, f"doc_id {kind}, subject string, share double")


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = DOCUMENT_SHARE) -> DataFrame:
    """doc_id, subject of every subject that holds at least ``share`` of a document's prose sentences."""
    return subject_shares(documents, labels, subjects).where(F.col("share") >= F.lit(share) - F.lit(1e-9)).select("doc_id", "subject")
