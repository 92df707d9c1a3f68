"""Line rules: counts against plain loops, each rule on small lines, odd inputs."""

import random
import re
from collections import Counter

from riskflow.llm import line_rules


def _plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def _counts(rows):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)


def test_counts_equal_plain_loops(spark, messy, messy_rows):
    got = line_rules.judge(messy).collect()
    assert _counts(got) == sorted((str(d), *_plain(t)) for d, t in messy_rows)


def test_counts_on_fuzzed_texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\t", "a b c ", "ü#", " \r\n", " "])
                        for _ in range(rng.randint(0, 60)))) for i in range(400)]
    got = line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert _counts(got) == sorted((str(d), *_plain(t)) for d, t in rows)


def test_lines_are_removed_by_rule(spark):
    text = "A plain sentence stands here.\nhome | news | sport | more\nno mark at all\nLOUD!! WORDS!! HERE!!\n" \
           "a&&& b*** c$$$ d.\nAll rights reserved.\nA plain sentence stands here.\n \nThe end, or is it?"
    (r,) = line_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_punctuation, r.n_navigation, r.n_boilerplate, r.n_dup_lines, r.n_lines) == (3, 1, 1, 1, 8)
    assert r.clean_text == "A plain sentence stands here.\nThe end, or is it?"


def test_documents_that_lose_too_much_are_rejected(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    bad = "\n".join(f"menu{i} | item{i} | more{i} | x{i}" for i in range(30))
    rows = [(1, good), (2, good + "\n" + bad), (3, bad), (4, good + "\nCopyright © someone")]
    kept = {r.doc_id: r.kept for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True}


def test_empty_table(nothing):
    assert line_rules.judge(nothing).count() == 0
