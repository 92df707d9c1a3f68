"""Quality rules, line first, in DataFrame functions.

Every line of a text is judged by itself; lines that fail a rule are removed, and a document
that loses more than ``MOST_LOST`` of its word characters with them is rejected.

* punctuation: no sentence mark in the line, or doubled marks behind ``MARKED_SHARE`` of its words;
* navigation: ``SEPARATORS`` or more menu separators, or symbols behind ``SYMBOL_SHARE`` of its words;
* boilerplate: a notice or prompt of ``NOTICES``, or a line equal to an earlier line of the text.

A line without a word is neither judged nor counted. The base rules on top of these are the
number of words and the share of words in repeated 3-word windows. Words are maximal runs of
characters other than space and U+0009 to U+000D.

Everything happens inside a row: one pass over the texts, no shuffle, no group. Windows are
first counted without repeats; only a text that repeats one sorts its windows. A row's arrays are proportional to its own text.

Defined results: null text is empty; an empty or blank text has no word, fails the base rules
and loses nothing; repeated rows get equal results; a null id stays null; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskflow.llm import common

LEAST_WORDS = 50
MOST_REPEATED = 50          # per cent of the words
MOST_LOST = 0.5
MARKED_SHARE = 0.3
SYMBOL_SHARE = 0.3
SEPARATORS = 3
WINDOW = 3

BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SENTENCE_MARK = r"[.!?…。！？।؟]"
DOUBLED_MARK = r"[!?]{2}(?:[\x20\x09-\x0D]|$)"
SEPARATOR_MARKS = "|»›•·>/"
SEPARATOR = rf"(?:^|[\x20\x09-\x0D])[{SEPARATOR_MARKS}](?:[\x20\x09-\x0D]|$)"

# Beginnings of notices and prompts that belong to a page, not to its text.
NOTICES = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "copyright ©", "enable javascript",
    "licensed under", "lorem ipsum", "powered by", "privacy policy", "read more", "share this", "sign in", "sign up",
    "subscribe to", "terms of service", "terms of use", "we use cookies",
)
NOTICE_WORDS = 25           # a longer line that mentions one is text


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK, -1), "")


def window_words(w: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that the text holds twice or more."""
    # words joined by single blanks; a window begins behind each blank and ends before one
    every = F.regexp_extract_all(F.array_join(w, " "), F.lit(rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{size - 1}}}))"), F.lit(1))

    def repeated(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["words"] == F.get(s, k)["words"], F.lit(False))
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(found, lambda j: F.get(s, j)["at"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"),
                           lambda n, i: n + F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(size))))

    def counted(x: Column) -> Column:
        ordered = F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("words"), i.alias("at"))))
        exact = _bound(ordered, lambda s: _bound(repeated(s), covered))
        return F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(exact)

    return F.when(F.size(w) <= size, F.lit(0).cast("long")).otherwise(_bound(every, counted))


def measured(line: Column) -> Column:
    """What the rules read of a line: the line, its words' number, and in lower case if it is short."""
    sized = F.struct(line.alias("line"), F.size(words(line)).alias("n"))
    return _bound(sized, lambda x: F.struct(
        x["line"].alias("line"), x["n"].alias("n"), F.when(x["n"] <= NOTICE_WORDS, F.lower(x["line"])).alias("low")))


def _holds(line: Column, parts) -> Column:
    return functools.reduce(lambda a, b: a | b, [line.contains(p) for p in parts])


def fault(x: Column) -> Column:
    """The first rule that a measured line (which holds a word) fails, or null; repeats aside."""
    line, n = x["line"], x["n"]
    unmarked = ~line.rlike(SENTENCE_MARK) | (
        _holds(line, ("!!", "??", "!?", "?!"))
        & (F.regexp_count(line, F.lit(DOUBLED_MARK)) >= MARKED_SHARE * n))
    menu = ((_holds(line, SEPARATOR_MARKS) & (F.regexp_count(line, F.lit(SEPARATOR)) >= SEPARATORS))
            | (_holds(line, "#*$%&|<>") & (F.regexp_count(line, F.lit(SYMBOL + "+")) >= SYMBOL_SHARE * n)))
    return (F.when(unmarked, F.lit("punctuation")).when(menu, F.lit("navigation"))
            .when((n <= NOTICE_WORDS) & _holds(x["low"], NOTICES), F.lit("boilerplate")))


def word_chars(text: Column) -> Column:
    """Code points other than blanks."""
    for blank in " \t\n\v\f\r":
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.length(text).cast("long")


def _failing(rule: str) -> Column:
    return F.size(F.filter("judged", lambda x: x["fault"] == rule)).cast("long")


def judge(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """(doc_id, text) -> counts, the cleaned text, the share lost and the verdict of each document."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one-element generators: their values are computed once, however often they are read below
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select("doc_id", "text", F.explode(F.array(F.struct(words(F.col("text")).alias("w"), lines.alias("lines")))).alias("c"))
    judged = F.transform(F.array_distinct("c.lines"), lambda x: _bound(
        measured(x), lambda m: F.struct(m["line"].alias("line"), fault(m).alias("fault"))))
    cut = cut.select("doc_id", "text", "c", F.explode(F.array(judged)).alias("judged"))
    left = F.filter("judged", lambda x: x["fault"].isNull())
    n_words = F.size("c.w").cast("long")
    counted = cut.select(
        "doc_id", n_words.alias("n_words"), word_chars(F.col("text")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("c.lines") - F.size("judged")).cast("long").alias("n_dup_lines"),
        window_words(F.col("c.w")).alias("n_repeat_words"), F.size("c.lines").cast("long").alias("n_lines"),
        *[_failing(name).alias(f"n_{name}") for name in ("punctuation", "navigation", "boilerplate")],
        F.array_join(F.transform(left, lambda x: x["line"]), "\n").alias("clean_text"))
    lost = F.when(F.col("word_chars") == 0, 0.0).otherwise(1 - word_chars(F.col("clean_text")) / F.col("word_chars"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (counted.withColumn("lost", lost).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= most_lost)))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; one row per document with its verdict."""
    judged = judge(common.id_and_text(common.table(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "n_punctuation", "n_navigation", "n_boilerplate", F.sha2("clean_text", 256).alias("clean_sha256"))


_NOTICE_SQL = " or ".join(f"contains(low, '{x}')" for x in NOTICES)

OP11_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
wc as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r),
g as (select r, i, word, lead(word, 1) over o as b, lead(word, 2) over o as c from w window o as (partition by r order by i)),
twice as (select r, i from (select r, i, count(*) over (partition by r, word, b, c) as n from g where c is not null) where n > 1),
rep as (select r, count(distinct i + k) as n_repeat_words from twice, (select unnest([0, 1, 2]) as k) group by r),
l as (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
f as (select r, line, min(i) as i, count(*) as copies, lower(line) as low,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
      from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r, line),
j as (select *, case
        when not regexp_matches(line, '[.!?\x{{2026}}\x{{3002}}\x{{FF01}}\x{{FF1F}}\x{{0964}}\x{{061F}}]')
             or len(regexp_extract_all(line, '[!?]{{2}}(?:[\x20\x09-\x0D]|$)')) >= 0.3 * n then 'punctuation'
        when len(regexp_extract_all(line, '(?:^|[\x20\x09-\x0D])[|\x{{00BB}}\x{{203A}}\x{{2022}}\x{{00B7}}>/](?:[\x20\x09-\x0D]|$)')) >= 3
             or (regexp_matches(line, '[#*$%&|<>]') and len(regexp_extract_all(line, '[#*$%&|<>]+')) >= 0.3 * n) then 'navigation'
        when n <= {NOTICE_WORDS} and ({_NOTICE_SQL}) then 'boilerplate' end as fault from f),
s as (select r, sum(copies) as n_lines, sum(copies - 1) as n_dup_lines, count(*) filter (fault = 'punctuation') as n_punctuation,
             count(*) filter (fault = 'navigation') as n_navigation, count(*) filter (fault = 'boilerplate') as n_boilerplate,
             coalesce(string_agg(line, chr(10) order by i) filter (fault is null), '') as clean from j group by r),
a as (select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines,
             coalesce(n_punctuation, 0)::bigint as n_punctuation, coalesce(n_navigation, 0)::bigint as n_navigation,
             coalesce(n_boilerplate, 0)::bigint as n_boilerplate, coalesce(clean, '') as clean
      from d left join wc using (r) left join rep using (r) left join s using (r)),
b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and (1 - length(regexp_replace(clean, '[\x20\x09-\x0D]+', '', 'g')) / word_chars) <= {MOST_LOST} as kept,
       n_lines, n_punctuation, n_navigation, n_boilerplate, sha256(clean) as clean_sha256
from b
"""
