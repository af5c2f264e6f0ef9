"""Quality rules: a threshold table compiled into one projection.

Native: every metric is a built-in expression over one row, so there is no
shuffle and no Python. A null text counts as empty; such documents have zero in
every metric and fail on length. Extra columns of the input are kept as they
are, and repeated rows are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import BLANKS, let, table

# fixed values: frequent function words of the languages of the corpus
STOP_WORDS = {
    "en": "the of and to in a is that it for on are as with was this be by from at or have not",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les de des et un une du que qui dans pour est pas sur avec en ce au",
    "es": "el la los las de y en que un una por con no para es se del lo como su",
}

#: metric, comparison, bound; a document is kept if all hold.
THRESHOLDS: list[tuple[str, str, float]] = [
    ("n_words", ">=", 50),
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 20.0),
    ("symbol_ratio", "<=", 0.3),
    ("stop_word_ratio", ">=", 0.01),
    ("dup_char_ratio", "<=", 0.3),
    ("repeat_word_ratio", "<=", 0.5),
]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_dup_chars", "n_line_chars", "n_stop_words", "n_repeat_words"]
MADE = ("_q", "_kept", "_failed")

METRICS = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
    # by characters: a short line that stands twice in a text of few lines is a small part of it
    "dup_char_ratio": "n_dup_chars / greatest(n_line_chars, 1)",
    "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
}


def compile_thresholds(thresholds: list[tuple[str, str, float]]) -> tuple[Column, Column]:
    """The table as (verdict, list of the rules that failed)."""
    tests = [(f"{m} {op} {bound:g}", F.expr(f"({METRICS.get(m, m)}) {op} {bound!r}")) for m, op, bound in thresholds]
    kept = F.lit(True)
    for _, test in tests:
        kept = kept & test
    failed = F.filter(F.array(*[F.when(~test, F.lit(name)) for name, test in tests]), lambda x: x.isNotNull())
    return kept, failed


def _repeat_words(grams: Column) -> Column:
    """Words inside 3-word windows whose hash stands twice or more in ``grams``."""

    def of_sorted(z: Column) -> Column:
        twice = F.filter(
            z, lambda e, k: (e["h"] == F.get(z, k - 1)["h"]).eqNullSafe(True) | (e["h"] == F.get(z, k + 1)["h"]).eqNullSafe(True)
        )
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        # least() skips the null after the last window
        return let(
            at,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(3), F.get(p, k + 1) - x)), F.lit(0), lambda s, x: s + x
            ),
        )

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, of_sorted))


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, _q): the rows of ``docs`` as a struct, and the struct of all counts.

    n_words, word_chars, n_symbols, n_dup_lines, n_dup_chars (of those lines),
    n_line_chars (of all lines), n_stop_words and n_repeat_words. Windows are
    compared by a 64-bit hash of their three words.
    """
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.trim(body, F.lit(BLANKS))
    # the row is packed, so columns of any name stay apart from those made here
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), body.alias("_t"), bare.alias("_b"))
    step = step.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", r"[\x20\x09-\x0D]+")))
    step = step.withColumn(
        "_h",
        F.slice(
            F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))),
            1,
            F.greatest(F.size("_w") - 2, F.lit(0)),
        ),
    )
    step = step.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != ""))
    line_chars, once_chars = (F.length(F.array_join(x, "")) for x in (F.col("_l"), F.array_distinct("_l")))
    q = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_t", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        (line_chars - once_chars).cast("long").alias("n_dup_chars"),
        line_chars.cast("long").alias("n_line_chars"),
        F.size(F.filter("_w", lambda x: F.lower(F.rtrim(x, F.lit(",.;:!?"))).isin(stop))).cast("long").alias("n_stop_words"),
        _repeat_words(F.col("_h")).cast("long").alias("n_repeat_words"),
    )
    # always true; a seeded expression that Catalyst won't copy into filters above,
    # where each rule would count everything anew
    once = F.when(F.monotonically_increasing_id() >= 0, q)
    return step.select("_row", once.alias("_q"))


def quality_rules(docs: DataFrame, text: str = "text", thresholds=None) -> DataFrame:
    """Every row of ``docs`` with ``_q`` (counts), ``_kept`` and ``_failed`` (rules); columns of those names are replaced."""
    kept, failed = compile_thresholds(THRESHOLDS if thresholds is None else thresholds)
    measured = metrics(docs, text)
    flat = measured.select("_row", "_q", *[F.col(f"_q.{n}").alias(n) for n in COUNTS])
    return flat.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in MADE], "_q", kept.alias("_kept"), failed.alias("_failed"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = [F.col(f"_q.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    return judged.select("doc_id", *q, failed.alias("base_failed"), (~failed & F.col("_kept")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    kept, _ = compile_thresholds(THRESHOLDS)
    measured = metrics(docs)
    return measured.select("_row", *[F.col(f"_q.{n}").alias(n) for n in COUNTS]).where(kept).select("_row.*")


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
ORACLE = f"""
with w as (
  select doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
g as (
  select *, row_number() over () as rid from w),
tri as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from g)),
dup as (
  select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from tri) where n > 1),
rep as (
  select rid, count(distinct i + d) as n from dup, (select unnest([0, 1, 2]) as d) group by rid),
m as (
  select doc_id, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l,
    cast(len(list_filter(w, lambda x: lower(rtrim(x, ',.;:!?')) in ({_STOP_SQL}))) as bigint) as n_stop,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from g left join rep using (rid)),
q as (
  select *, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    length(array_to_string(l, '')) as line_chars, length(array_to_string(l, '')) - length(array_to_string(list_distinct(l), '')) as dup_chars,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed
    and word_chars / greatest(n_words, 1) between 2.0 and 20.0
    and n_symbols / greatest(n_words, 1) <= 0.3
    and n_stop / greatest(n_words, 1) >= 0.01
    and dup_chars / greatest(line_chars, 1) <= 0.3
    and n_repeat_words / greatest(n_words, 1) <= 0.5 as kept
from q
"""
