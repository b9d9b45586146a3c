"""Secrets in text: fixed formats, and a randomness test battery for everything else. SQL functions only.

Spans come without a UDF: the matches of a pattern and the pieces between them
alternate, so running sums of their lengths give each match's place.

The battery looks at long unbroken tokens. The encoding is inferred from the
symbols (hexadecimal, base32, base64). Three tests are made of each token:
chi-squared of the symbol counts against uniform ones, runs of symbols, and the
correlation of each symbol's index with the next. Each test has two tails. One
asks whether the token could be uniform noise over its alphabet; tokens that a
test rejects at level ``alpha`` are out. The other asks how likely an ordinary
word or identifier comes as close to noise: its symbols are as uneven as those
of text (a chi-squared variable shifted by the length), its runs change between
cases and digits as seldom (a binomial tail), and its neighbours are alike (a
correlation of LIKENESS). These three tails are joined by Fisher's rule into
one. All fall off with the length, so a short token must look far more mixed
than a long one. A Benjamini-Hochberg step over the joined tails of all
candidates of all documents then keeps the expected share of false finds below
``fdr``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import table

ASSIGN = r"""(?=[PpSsTtAa])((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A lookahead or lookbehind here changes no match; it spares the scanner most positions.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens for the battery: unbroken and 20 symbols or more. Those without a digit or an inner capital are dropped after.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
SWITCH = 0.08  # how often ordinary tokens change between cases and digits, a step
#: How uneven ordinary tokens are (chi-squared per symbol beyond noise) and how alike their neighbours.
UNEVEN = {"hex": 0.6, "base32": 1.0, "base64": 2.5}
LIKENESS = 0.2
#: Matches of a pattern in one text that are placed at a time.
CHUNK = 256


def _spans(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, token)`` of the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    steps = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), found.alias("token"))

    def size(m: Column) -> Column:
        return F.coalesce(m["gap"], F.lit(0)) + F.coalesce(F.length(m["token"]), F.lit(0))

    def placed(part: Column, at: Column) -> Column:
        return F.aggregate(
            part, F.struct(at.alias("at"), none.alias("out")),
            lambda acc, m: F.struct(
                (acc["at"] + size(m)).alias("at"),
                F.when(m["token"].isNull(), acc["out"]).otherwise(
                    F.concat(acc["out"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + F.length(m["token"])).alias("end"), m["token"].alias("token"))))
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def chunked(all_steps: Column) -> Column:
        """Arrays grow by copying, so a text with very many matches is placed chunk by chunk, each from the sum of those before."""
        chunks = F.transform(F.sequence(F.lit(0), F.size(all_steps) - 1, F.lit(CHUNK)), lambda c: F.slice(all_steps, c + 1, F.lit(CHUNK)))
        sums = F.transform(chunks, lambda part: F.aggregate(part, F.lit(0), lambda acc, m: acc + size(m)))
        starts = F.aggregate(
            sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(chunks, starts, placed))

    return F.when(text.rlike(pattern), F.get(F.transform(F.array(steps), lambda s: F.when(F.size(s) <= CHUNK, placed(s, F.lit(0))).otherwise(chunked(s))), F.lit(0))).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal, by a rational approximation (error below 1e-7), for z of either sign."""
    def t(k: float) -> Column:
        return F.pow(1 / (1 + 0.2316419 * F.abs(z)), F.lit(k))

    # A published polynomial for the normal tail.
    poly = 0.319381530 * t(1.0) - 0.356563782 * t(2.0) + 1.781477937 * t(3.0) - 1.821255978 * t(4.0) + 1.330274429 * t(5.0)
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(spans: Column) -> Column:
    """The spans with their encoding, the least p-value of the three tests as noise (``noise``) and the log10 of their joint tail as ordinary tokens (``mixed``).

    Worked out in steps over the array, each naming what the next ones use
    several times: within a lambda nothing that repeats is shared.
    """
    def body(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["token"], "=+$", "").alias("body"))

    def encoding(s: Column) -> Column:
        kind = F.when(s["body"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(s["body"].rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), kind.alias("kind"))

    def symbols(s: Column) -> Column:
        letters = F.when(s["kind"] == "hex", ALPHABETS["hex"]).when(s["kind"] == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        folded = F.when(s["kind"] == "hex", F.lower(s["body"])).otherwise(F.translate(s["body"], "-_", "+/"))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), s["kind"].alias("kind"), letters.alias("letters"),
            folded.alias("folded"), F.length(letters).cast("double").alias("size"), F.greatest(F.length(folded).cast("double"), F.lit(1.0)).alias("n"),
        )

    def counted(s: Column) -> Column:
        squares = F.aggregate(
            F.filter(F.split(s["letters"], ""), lambda c: c != ""), F.lit(0.0),
            lambda acc, c: acc + F.pow((F.length(s["folded"]) - F.length(F.replace(s["folded"], c, F.lit("")))).cast("double"), F.lit(2.0)),
        )
        walk = F.aggregate(
            F.filter(F.split(s["folded"], ""), lambda c: c != ""),
            F.struct(*[F.lit(v).alias(k) for k, v in (("last", -1.0), ("runs", 0.0), ("high", 0.0), ("s", 0.0), ("ss", 0.0), ("lag", 0.0))]),
            lambda a, c: _walk(a, F.instr(s["letters"], c).cast("double"), s["size"]),
        )
        # Lower case, upper case and digits as one sign each, repeats dropped: as long as the token has runs.
        classes = F.translate(F.translate(F.translate(s["body"], "bcdefghijklmnopqrstuvwxyz", "a" * 25), "BCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 25), "123456789", "0" * 9)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["size"].alias("size"), s["n"].alias("n"),
            squares.alias("squares"), walk.alias("walk"), F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double").alias("mixes"),
        )

    def moments(s: Column) -> Column:
        walk, n, free = s["walk"], s["n"], s["size"] - 1
        mean = walk["s"] / n
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), n.alias("n"), walk["runs"].alias("runs"),
            free.alias("free"), (s["squares"] * s["size"] / n - n).alias("chi"),
            # The cube root of a chi-squared variable over its mean is nearly normal.
            ((F.cbrt(F.greatest(s["squares"] * s["size"] / n - n, F.lit(1e-9)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))).alias("z_chi"),
            (1 + 2 * walk["high"] * (n - walk["high"]) / n).alias("mean_runs"),
            mean.alias("mean"), (walk["ss"] / n - mean * mean).alias("spread"), walk["lag"].alias("lag"),
            ((s["mixes"] - 1) / F.greatest(n - 1, F.lit(1.0))).alias("share"),
        )

    def scores(s: Column) -> Column:
        n, steps = s["n"], F.greatest(s["n"] - 1, F.lit(1.0))
        var_runs = (s["mean_runs"] - 1) * (s["mean_runs"] - 2) / steps
        uneven = F.when(s["kind"] == "hex", UNEVEN["hex"]).when(s["kind"] == "base32", UNEVEN["base32"]).otherwise(UNEVEN["base64"]) * n
        serial = F.when(s["spread"] > 0, (s["lag"] / steps - s["mean"] * s["mean"]) / s["spread"] + 1 / n).otherwise(F.lit(1.0))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), steps.alias("steps"), s["share"].alias("share"), s["z_chi"].alias("z_chi"),
            # How far below what ordinary tokens have: a shifted chi-squared variable and a correlation, both nearly normal.
            F.greatest((s["free"] + uneven - s["chi"]) / F.sqrt(2 * (s["free"] + 2 * uneven)), F.lit(0.0)).alias("even"),
            F.greatest((F.lit(LIKENESS) - serial) * F.sqrt(n), F.lit(0.0)).alias("unlike"),
            F.when(var_runs > 0, F.abs(s["runs"] - s["mean_runs"]) / F.sqrt(var_runs)).otherwise(F.lit(9.0)).alias("z_runs"),
            F.when(s["spread"] > 0, F.abs((s["lag"] / steps - s["mean"] * s["mean"]) / s["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0)).alias("z_serial"),
        )

    def tails(s: Column) -> Column:
        share = s["share"]
        # Chernoff's bound of the binomial tail: exp(-steps * KL(share || SWITCH)).
        kl = F.when(share <= SWITCH, 0.0).when(share >= 1, -math.log(SWITCH)).otherwise(share * F.log(share / SWITCH) + (1 - share) * F.log((1 - share) / (1 - SWITCH)))
        # Each tail by its exponent; Fisher's sum of three has the tail exp(-x) (1 + x + x^2 / 2).
        total = s["steps"] * kl + s["even"] * s["even"] / 2 + s["unlike"] * s["unlike"] / 2
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("encoding"),
            F.least(_upper_tail(s["z_chi"]), 2 * _upper_tail(s["z_runs"]), 2 * _upper_tail(s["z_serial"])).alias("noise"),
            ((F.log(1 + total + total * total / 2) - total) / math.log(10)).alias("mixed"),
        )

    for step in (body, encoding, symbols, counted, moments, scores, tails):
        spans = F.transform(spans, step)
    return spans


def _walk(a: Column, x: Column, size: Column) -> Column:
    high, was = x > size / 2, a["last"] > size / 2
    return F.struct(
        x.alias("last"),
        (a["runs"] + F.when((a["last"] < 0) | (high != was), 1.0).otherwise(0.0)).alias("runs"),
        (a["high"] + F.when(high, 1.0).otherwise(0.0)).alias("high"),
        (a["s"] + x).alias("s"), (a["ss"] + x * x).alias("ss"),
        (a["lag"] + F.when(a["last"] < 0, 0.0).otherwise(a["last"] * x)).alias("lag"),
    )


def _texts(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    """By start, then by kind in the listed order."""
    return F.array_sort(spans)


def scan(docs: DataFrame, *, alpha: float = 1e-3, fdr: float = 0.01) -> DataFrame:
    """Secrets of every whole text; a row per row of ``docs``.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``.
    A span reads ``kind:start:end`` in code points, end exclusive. Base kinds
    are ``assign`` (a name, a sign and a value of 12 symbols or more),
    ``access`` and ``hex``; ``random`` ones come from the battery and never
    replace a base one: those that lie wholly inside a base span are left out.
    Null texts are empty, empty texts have no spans (the hash is that of an
    empty string), repeated rows are each scanned, other columns ignored.
    """
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        F.filter(_spans(F.col("t"), ASSIGN), lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= 12).alias("assign"),
        _spans(F.col("t"), ACCESS).alias("access"),
        _spans(F.col("t"), HEX).alias("hex"),
        F.filter(_spans(F.col("t"), TOKEN), lambda s: s["token"].rlike("[0-9]|[a-z][A-Z]")).alias("long"),
    )

    def base(name: str, rank: int) -> Column:
        return F.transform(F.coalesce(F.col(name), none), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")))

    found = table(
        raw.select(
            "doc_id",
            F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
            F.concat(base("assign", 0), base("access", 1), base("hex", 2)).alias("base"),
            F.filter(_battery(F.col("long")), lambda s: s["noise"] >= alpha).alias("random"),
        ),
        "secrets",
    )
    cut = _false_discovery_cut(found, fdr)
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    extra = F.transform(
        F.filter("random", lambda s: (s["mixed"] <= cut) & ~inside(s)),
        lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("random").alias("kind")),
    )
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_texts(_ordered(F.col("base"))), 256).alias("base_sha256"),
        _texts(_ordered(F.concat("base", extra))).alias("spans"),
        F.size(extra).cast("long").alias("n_random"),
    )


def _false_discovery_cut(found: DataFrame, fdr: float) -> float:
    """Largest log10 tail that the step-up rule accepts over all candidates, or below every tail if none is.

    Tails are counted in steps of 0.01 down to -300, so at most 30,001 counts reach the driver.
    """
    steps = (
        found.select(F.explode("random").alias("s")).select(F.ceil(F.greatest(F.col("s.mixed"), F.lit(-300.0)) * 100).alias("k"))
        .groupBy("k").count().collect()
    )
    total, seen, cut = sum(r["count"] for r in steps), 0, -1e9
    for k, count in sorted((r["k"], r["count"]) for r in steps):
        seen += count
        if k / 100 <= math.log10(fdr * seen / total):
            cut = k / 100
    return cut
