"""Secret scan: sliding-window Shannon entropy per character class.

Three fixed patterns give the base spans. Beside them, every run of 20 or more
token characters is a candidate. Its character class (hex, alphanumeric,
base64) has a threshold of its own. The entropy of each 20-character window is
kept by incremental counts: one character enters, one leaves, and the sum of
c * log2(c) changes by those two terms only. The greatest window decides.
Allow-listed candidates (UUIDs, digits only, letters only, paths, marked
examples, digests after "sha256:" and the like, runs of an alphabet) are not
added. Base spans always stay.

Native, one projection, no shuffle. Time is linear in a text, however long a
candidate or however many matches. A null text counts as empty. Repeated rows
are scanned row by row; of two candidates that overlap the first stays. No rows,
no result. Columns of any name are kept, but for the two that are made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import spans as sp
from taskloom.llm.common import let, table

KINDS = ["assign", "access", "hex", "entropy"]
WINDOW = 20

# fixed patterns; possessive repeats match the same strings without backtracking
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: Class pattern -> least window entropy in bits, the first class that fits counts.
CLASSES: list[tuple[str, str, float]] = [
    ("hex", r"^[0-9a-fA-F]+$", 3.0),
    ("alnum", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7),
]

#: A candidate that matches one of these is let go.
ALLOW = [
    r"^[0-9]+$",  # numbers
    r"^[^0-9]+$",  # words, joined words and rules of - or =
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)example|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh|qwerty",
    r"^/?(?:[A-Za-z]++[0-9]*+[/_-])++[A-Za-z]*+[0-9]*+$",  # paths and slugs of words
    r"^(?:[A-Za-z0-9_]+=)?[0-9_./+=-]+$",  # versions, dates, numeric ranges
]
#: Text just before a candidate that names it as a digest or an id of public record.
ALLOW_BEFORE = r"(?i)(?:sha-?(?:1|256|384|512)|md5|commit|checksum|digest|integrity|uuid)[:=\s-]{0,3}$"


def base(text: Column) -> Column:
    """assign, access and hex spans of ``text`` as the contract states them."""
    assign = sp.find(text, ASSIGN, "assign", text.rlike(r"(?i)passw|secret|token|api_?key"))
    assign = F.filter(assign, lambda x: F.length(F.regexp_extract(x["s"], ASSIGN_VALUE, 1)) >= 6)
    access = sp.find(text, ACCESS, "access", F.contains(text, F.lit("AKIA")))
    hexes = sp.find(text, HEX, "hex", text.rlike(HEX))
    return F.concat(assign, access, hexes)


def window_entropy(s: Column, width: int = WINDOW) -> Column:
    """Greatest Shannon entropy, in bits, of the ``width``-character windows of ASCII ``s``; 0 for shorter ones.

    The fold holds the sum of c * log2(c) over the window's characters. A step
    counts the entering and the leaving character among the window's, so it
    costs the same at any place of a text of any length.
    """
    term = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(width + 2)])

    def walked(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enter, leave = F.get(codes, i), F.get(codes, i - width)
            window = F.slice(codes, F.greatest(i - width + 1, F.lit(1)), F.least(i, F.lit(width)))  # before this step

            def moved(w: Column) -> Column:
                count = lambda x: F.size(F.filter(w, lambda y: y == x))
                gone = F.when(leave.isNull(), 0.0).otherwise(let(count(leave), lambda n: F.get(term, n - 1) - F.get(term, n)))
                held = count(enter) - F.coalesce((leave == enter).cast("int"), F.lit(0))
                return acc["t"] + gone + let(held, lambda n: F.get(term, n + 1) - F.get(term, n))

            def topped(t: Column) -> Column:
                return F.struct(t.alias("t"), F.when(i >= width - 1, F.greatest(acc["top"], F.lit(math.log2(width)) - t / width)).otherwise(acc["top"]).alias("top"))

            return let(let(window, moved), topped)

        zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("top"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: acc["top"])

    return F.when(F.length(s) < width, F.lit(0.0)).otherwise(let(F.transform(F.split(s, ""), lambda c: F.ascii(c)), walked))


def _passes(text: Column, x: Column) -> Column:
    ok = F.lit(True)
    for pattern in ALLOW:
        ok = ok & ~x["s"].rlike(pattern)
    before = F.substring(text, F.greatest(x["start"] - 19, F.lit(1)), F.least(F.lit(20), x["start"]))
    ok = ok & ~before.rlike(ALLOW_BEFORE)

    def enough(h: Column) -> Column:
        test = F.lit(False)
        for _, pattern, least in reversed(CLASSES):
            test = F.when(x["s"].rlike(pattern), h >= least).otherwise(test)
        return test

    return F.when(ok, let(window_entropy(x["s"]), enough)).otherwise(F.lit(False))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans`` (base and added), sorted by start and kind; columns of those names are replaced."""
    # the row is packed, so columns of any name stay apart from those made here
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    step = step.withColumn("_b", base(F.col("_t")))
    found = sp.find(F.col("_t"), CANDIDATE, "entropy", F.col("_t").rlike(CANDIDATE))
    found = let(F.transform(found, lambda x: F.struct(F.lit(1.0).alias("p"), x.alias("x"))), lambda f: sp.chosen(f, F.col("_b")))
    step = step.withColumn("_m", F.filter(found, lambda x: _passes(F.col("_t"), x)))
    return step.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("_base", "_spans")],
        sp.ordered(F.col("_b"), KINDS).alias("_base"),
        sp.ordered(F.concat("_b", "_m"), KINDS).alias("_spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_redacted``: the text with every span replaced by its kind."""
    found = scan(docs, text)
    return found.withColumn("_redacted", sp.redacted(F.coalesce(F.col(text), F.lit("")), F.col("_spans")))


def op2_entropy_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[sp.count(F.col("_base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(sp.joined(F.col("_base")), 256).alias("base_sha256"),
        sp.joined(F.col("_spans")).alias("spans"),
    )
