import re
from collections import Counter

import pytest
from edge_rows import TEXTS, edge_rows, empty_rows, texts_of

from dispatchmart.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def fault(line):
    words = WORD.findall(line)
    if not words:
        return None
    if not re.search("[.!?…。！？][\"'”’»)\\]]*(\\s|$)", line) or 3 * len(re.findall("[!?]{2,}", line)) > len(words):
        return "punctuation"
    separators = len(re.findall("[|»›•·>]", line))
    if separators >= 3 and len(words) <= 6 * separators:
        return "navigation"
    if len(words) <= 25 and any(phrase in line.lower() for phrase in rules.BOILERPLATE):
        return "boilerplate"
    return None


def brute_force(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, window in enumerate(windows) if times[window] > 1 for k in range(3)}
    lines = text.split("\n")
    full = [line for line in lines if WORD.search(line)]
    faults = [fault(line) for line in lines]
    size = sum(map(len, lines))
    lost = sum(len(line) for line, f in zip(lines, faults) if f) / size if size else 0.0
    base = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_dup_lines": len(full) - len(set(full)),
        "n_repeat_words": len(repeated),
        "n_punctuation_lines": faults.count("punctuation"),
        "n_navigation_lines": faults.count("navigation"),
        "n_boilerplate_lines": faults.count("boilerplate"),
        "clean_text": "\n".join(line for line, f in zip(lines, faults) if not f),
        "base_failed": base,
        "kept": not base and lost <= 0.5,
    }


SENTENCES = "\n".join(f"Line{i} tells{i} what{i} others{i} of{i} them{i} had{i}. Then{i} ends{i}." for i in range(12))
MENU = "Home | News | Sport | Contact.\n" * 3
PAGES = [
    SENTENCES,
    MENU + SENTENCES,
    SENTENCES + "\nAll Rights Reserved. Licensed under terms.\n\n",
    "\n".join(f"Go {i} | Back {i} | Top {i} | Up {i}." for i in range(30)) + "\n" + SENTENCES[:200],
    "no sentence ends here at all " * 20 + "\n" + SENTENCES[:60],
    "WOW!! BUY!! NOW!! " * 30 + "\n" + SENTENCES,
    "a b c d a b c x a b c " * 9,
    "x y z x y z x y",
    "a a a a",
]


@pytest.mark.parametrize("text", [t for t in TEXTS if t] + PAGES)
def test_measures_agree_with_brute_force(spark, text):
    got = rules.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().asDict()
    want = brute_force(text)
    assert {k: got[k] for k in want} == want


def test_edge_rows(spark):
    rows = edge_rows(spark)
    got = sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in rules.measure(rows).collect())
    want = [(str(i), brute_force(t)["n_words"], brute_force(t)["kept"]) for i, t in texts_of(rows)]
    assert got == sorted(want)
    assert rules.measure(empty_rows(spark)).count() == 0


def test_clean_keeps_columns_and_removes_failed_lines(spark):
    rows = spark.createDataFrame([(i, t, "a", True) for i, t in enumerate(PAGES)], "doc_id long, text string, _row string, kept boolean")
    got = {r["doc_id"]: r for r in rules.clean(rows).collect()}
    assert list(got[0].asDict()) == rows.columns
    assert {i: got[i]["text"] for i in got} == {
        i: brute_force(t)["clean_text"] for i, t in enumerate(PAGES) if brute_force(t)["kept"]
    }
    assert rules.clean(empty_rows(spark)).count() == 0


def test_no_python_and_no_shuffle(spark):
    plan = rules.measure(edge_rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
