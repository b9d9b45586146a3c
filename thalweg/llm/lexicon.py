"""Toxicity scores from a weighted lexicon that is matched by Aho-Corasick.

Text is folded first: case, compatibility forms (full-width, mathematical and
other styled letters) and accents to plain letters, homoglyphs (Cyrillic and
Greek look-alikes) to Latin letters, and digits or signs that stand for letters
inside a word to those letters. The lexicon is learned from
labelled rows: word beginnings and whole words that are far more common in
toxic rows than in others get a log-odds weight. Phrases that hold an entry but
occur in clean rows become exceptions, which cancel the entry they cover. A
document's score is a logistic function of its matched weight and of that
weight per word, so a few insults in a long text still count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import held_out

# Look-alike letters and the Latin letters they are read as.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "ⅼ": "l",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
}
# Digits and signs written for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))
_MARKS = re.compile("[\u0300-\u036f]+")
_SIGN = {ord(k): v for k, v in SIGNS.items()}


def fold(text: str | None) -> list[str]:
    """The folded words of a text: lower case, look-alikes and inner digits resolved, outer signs off."""
    out = []
    text = text or ""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_FOLD)
    for word in text.lower().split():
        if not word.isalpha():
            core = word.strip(".,;:!?\"'()[]{}<>|*#%&$-_")
            if core and not core.isalpha() and any(map(str.isalpha, core)):
                core = "".join(c for c in core.translate(_SIGN) if c.isalpha())
            word = core
        if word:
            out.append(word)
    return out


@dataclass
class Lexicon:
    """entries: pattern to weight, a leading space marks a word start and a closing one its end.
    exceptions: folded phrases whose matches don't count. bias, slope, density: of the logistic score."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -3.0
    slope: float = 1.0
    density: float = 0.0

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, weight in self.entries.items():
            machine.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(machine):
            machine.make_automaton()
        return machine

    def measure(self, words: list[str], machine) -> tuple[float, float]:
        """Matched weight, and that weight per hundred words, exceptions taken off.

        At each word the heaviest entry counts once, however many match it.
        """
        if not len(machine) or not words:
            return 0.0, 0.0
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in machine.iter(line):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        total = sum(best.values())
        return total, 100.0 * total / len(words)

    def score(self, weight: float, density: float) -> float:
        z = self.bias + self.slope * math.log1p(weight) + self.density * math.log1p(density)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def learn(rows: list[tuple[str | None, int]], *, least_docs: int = 4, stem: int = 4, ratio: float = 5.0) -> Lexicon:
    """A lexicon from ``(text, toxic)`` rows.

    An entry is a word, or a word beginning of ``stem`` to 8 letters with at
    least two continuations, found in ``least_docs`` toxic rows or more and at
    least ``ratio`` times as often (smoothed) in toxic rows as in others, more
    than chance would give any of the words looked at.
    Beginnings that a shorter, no less telling one covers are left out.
    Without rows of both kinds the lexicon is empty and scores are the bias.
    """
    folded = [(fold(t), int(y)) for t, y in rows if y is not None]
    toxic, clean = sum(y for _, y in folded), sum(1 - y for _, y in folded)
    if not toxic or not clean:
        return Lexicon(bias=3.0 if toxic else -3.0)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    shapes: dict[str, set[str]] = {}
    for words, y in folded:
        found = set()
        for w in set(words):
            found.add(f" {w} ")
            for k in range(stem, min(8, len(w)) + 1):
                found.add(f" {w[:k]}")
                if y:
                    shapes.setdefault(f" {w[:k]}", set()).add(w)
        seen[y].update(found)
    odds = {}
    for p, n in seen[1].items():
        if n < least_docs or (not p.endswith(" ") and len(shapes.get(p, ())) < 2):
            continue
        if _chance(n, n + seen[0][p], toxic / (toxic + clean)) * len(seen[1]) > 0.5:
            continue
        weight = math.log((n + 0.5) / (toxic + 1)) - math.log((seen[0][p] + 0.5) / (clean + 1))
        if weight >= math.log(ratio):
            odds[p] = weight
    entries: dict[str, float] = {}
    for p in sorted(odds, key=lambda p: (len(p.strip()), p)):
        word = p.rstrip()
        shorter = [entries[word[:k]] for k in range(stem + 1, len(word) + (p != word)) if word[:k] in entries]
        if not shorter or odds[p] > max(shorter) + 1.5:
            entries[p] = odds[p]
    lexicon = Lexicon(entries)
    machine = lexicon.automaton()
    lexicon.exceptions = _exceptions(folded, lexicon, machine)
    machine = lexicon.automaton()
    x = np.array([[1.0, *map(math.log1p, lexicon.measure(w, machine))] for w, _ in folded])
    y = np.array([v for _, v in folded], dtype=float)
    lexicon.bias, lexicon.slope, lexicon.density = _logistic(x, y)
    return lexicon


def _chance(hits: int, rows: int, share: float) -> float:
    """A bound on how likely ``hits`` of ``rows`` or more come up by chance at a rate of ``share``."""
    rate = hits / rows
    if rate <= share:
        return 1.0
    gain = rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if rate < 1 else 0.0)
    return math.exp(-rows * gain)


def _exceptions(folded, lexicon: Lexicon, machine, least: int = 3) -> list[str]:
    """Two- and three-word phrases around an entry, in ``least`` clean rows or more and no toxic row."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in folded:
        if lexicon.measure(words, machine)[0] <= 0:
            continue
        found = set()
        for i, w in enumerate(words):
            if lexicon.measure([w], machine)[0] > 0:
                for a, b in ((i - 1, i + 1), (i, i + 2), (i - 1, i + 2), (i - 2, i + 1)):
                    if 0 <= a and b <= len(words):
                        found.add(" ".join(words[a:b]))
        counts[y].update(found)
    return sorted(p for p, n in counts[0].items() if n >= least and not counts[1][p])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are kept from falling below zero."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - y) + ridge * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(b)), grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), max(0.0, float(b[1])), max(0.0, float(b[2]))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, limit: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``limit`` labelled rows, the first by a hash of their id.

    Held-out rows never take part. The ids are at most ``limit``, so their
    broadcast is bounded whatever the tables' sizes. Rows with a null label or
    id are passed over; an id with several labels takes the largest.
    """
    chosen = (
        labels.select("doc_id", F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows ``(doc_id, score, weight)`` for each row of ``docs``, whole texts, null as empty.

    Other columns of ``docs`` are ignored. Repeated ids give repeated rows, an
    empty table none; ids pass through as they are, null or not.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in batches:
            found = [lexicon.measure(fold(t.as_py()), machine) for t in part.column("text")]
            columns = [part.column("doc_id"), pa.array([lexicon.score(*m) for m in found], pa.float64()), pa.array([m[0] for m in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, weight double")


def train_toxicity(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2, limit: int = 6000) -> Lexicon:
    """The lexicon of ``labels.toxic``, learned on the driver from a bounded sample (``limit`` rows)."""
    sample = training_sample(docs, labels, "toxic", modulus, remainder, limit)
    return learn([(r["text"], r["y"]) for r in sample.toLocalIterator()])
