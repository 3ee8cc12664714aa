"""Operator 5: quality rules as one projection of built-in expressions.

A table of thresholds over text statistics is compiled into a single Spark
projection; no user function runs.  Statistics are whole numbers and rules
compare products of them, so every engine gives the same verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = (" ", "\t", "\n", "\v", "\f", "\r")
_SYMBOLS = tuple("#*$%&|<>")
REPEAT_WINDOW = 8

#: Frequent words of the four languages; fixed values.
STOP_WORDS = (
    "a", "and", "for", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pour", "que", "qui", "sur", "un", "une",
    "con", "del", "el", "los", "no", "para", "por", "se", "su", "y",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
)


@dataclass(frozen=True)
class Rule:
    """``least * den <= 100 * num <= most * den``; a bound of None is open."""

    name: str
    num: str
    den: str
    least: int | None = None
    most: int | None = None

    def sql(self) -> str:
        parts = []
        if self.least is not None:
            parts.append(f"100 * {self.num} >= {self.least} * {self.den}")
        if self.most is not None:
            parts.append(f"100 * {self.num} <= {self.most} * {self.den}")
        return "(" + " and ".join(parts) + ")"


#: The base of every table: what fails it is never kept.
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols a word", "n_symbols", "n_words", None, 20),
    Rule("stop words", "n_stop_words", "n_words", 5, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
)


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    return " and ".join(r.sql() for r in rules)


def _without(column: Column, parts: tuple[str, ...]) -> Column:
    for p in parts:
        column = F.replace(column, F.lit(p), F.lit(""))
    return column


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, the statistics, base_failed and kept.

    A null text has no words, fails the base and is not kept, as an empty one.
    Null doc_ids and repeated rows pass through; an empty table gives no rows;
    other columns are ignored.
    """
    blanks = "".join(_SPACES)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    trimmed = F.trim(F.col("t"), F.lit(blanks))
    # split once; an empty text would give one empty word
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: F.trim(x, F.lit(blanks)) != "")
    rows = rows.select("doc_id", "t", words.alias("w"), lines.alias("l"))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.char_length("t") - F.octet_length("t") + F.octet_length(_without(F.col("t"), _SPACES))).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(_without(F.col("t"), _SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        _windows(F.col("w")).alias("h"),
    )
    rows = rows.select("*", (F.size(F.array_distinct("h")) < F.size("h")).alias("again"))
    # only a text with an equal pair of windows sorts them
    marked = F.when(F.col("again"), _repeated_places(F.col("h")))
    rows = rows.select(*[c for c in rows.columns if c not in ("h", "again")], marked.alias("p"))
    repeats = F.when(F.col("p").isNotNull(), _covered(F.col("p"))).otherwise(F.lit(0))
    rows = rows.select(*[c for c in rows.columns if c != "p"], repeats.cast("long").alias("n_repeat_words"))
    rows = rows.withColumn("base_failed", F.expr(BASE_FAILED))
    kept = ~F.col("base_failed") & F.expr(verdict_sql(rules))
    return rows.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def _windows(w: Column) -> Column:
    """A hash of each 8-word window: of neighbouring pairs, of those two apart, of those four apart."""
    h = w
    for by in (1, 2, 4):
        h = _pairs(h, by)
    return h


def _pairs(a: Column, by: int) -> Column:
    # the one-element array names ``a``, which is then computed once
    def of(x: Column) -> Column:
        n = F.greatest(F.size(x) - by, F.lit(0))
        return F.zip_with(F.slice(x, 1, n), F.slice(x, by + 1, n), lambda p, q: F.xxhash64(p, q))

    return F.transform(F.array(a), of)[0]


def _repeated_places(h: Column) -> Column:
    """Ascending places of the windows that are found twice or more."""
    ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.transform(
        F.array(ranked),
        lambda s: F.array_sort(
            F.array_distinct(
                F.flatten(
                    F.zip_with(
                        F.slice(s, 1, F.size(s) - 1),
                        F.slice(s, 2, F.size(s) - 1),
                        lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")),
                    )
                )
            )
        ),
    )[0]


def _covered(p: Column) -> Column:
    """Words that windows at these ascending places cover."""
    gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: F.least(y - x, F.lit(REPEAT_WINDOW)))
    return F.aggregate(gaps, F.lit(REPEAT_WINDOW), lambda acc, x: acc + x)


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    space = r"[ \t\n\x0B\f\r]"
    return f"""
    with t as (select doc_id, coalesce(text, '') as t from documents),
    w as (
      select doc_id, t, regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as l from t
    ),
    s as (
      select doc_id, len(w)::bigint as n_words,
        length(regexp_replace(t, '{space}', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        len(list_filter(w, lambda x: x in ({stop})))::bigint as n_stop_words, w
      from w
    ),
    v as (
      select doc_id, w, n_words, unnest(range(1, n_words - {REPEAT_WINDOW - 2})) as i from s where n_words > {REPEAT_WINDOW}
    ),
    g as (select doc_id, i, array_to_string(w[i:i + {REPEAT_WINDOW - 1}], ' ') as g from v),
    r as (select doc_id, i, lead(i) over (partition by doc_id order by i) as j from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
    c as (select doc_id, sum(least({REPEAT_WINDOW}, coalesce(j - i, {REPEAT_WINDOW})))::bigint as n_repeat_words from r group by doc_id),
    f as (select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, n_lines, n_stop_words from s left join c on s.doc_id = c.doc_id)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) as base_failed,
      not ({BASE_FAILED}) and {verdict_sql(rules)} as kept, n_lines, n_stop_words
    from f"""
