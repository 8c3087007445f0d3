from collections import defaultdict

import pytest
from edge_rows import documents, edge_rows, empty_rows, texts_of

from dispatchmart.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, min_chars=20, min_docs=3):
    rows = [(-(2**63) if i is None else i, i, text) for i, text in rows]
    key = lambda line: line.strip(BLANKS).translate(A_TO_Z)
    holders = defaultdict(set)
    for owner, _, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(owner)
    out = []
    for owner, i, text in rows:
        cut = text.split("\n")
        kept = [x for x in cut if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == owner]
        out.append((i, len(cut), len(cut) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in lines.drop_shared_lines(df, **options).collect()), key=repr)


@pytest.mark.parametrize("given", [edge_rows, empty_rows])
def test_edge_rows(spark, given):
    assert got(given(spark)) == brute_force(texts_of(given(spark)))


def test_documents(spark, sf_dir):
    rows = documents(spark, sf_dir)
    assert got(rows) == brute_force(texts_of(rows))
    assert got(rows, min_chars=1, min_docs=2) == brute_force(texts_of(rows), 1, 2)


SHARED = "A line that many documents hold"
ROWS = [
    (1, f"{SHARED}\nown line of the first one, long enough\n{SHARED}"),
    (2, f"\t {SHARED.upper()} \r\n"),
    (3, f"{SHARED}\n{SHARED}\nshort\nshort"),
    (3, f"{SHARED} \nthe same document again, other text"),
    (4, "Ünderline thät ıs shared by thrée"),
    (4, "Ünderline thät ıs shared by thrée"),
    (5, "ünderline thät ıs shared by thrée"),
    (6, "Ünderline thät ıs shared by thrée"),
    (7, "éééééééééééééééééééé\nééééééééééééééééééé"),
    (8, "éééééééééééééééééééé\nééééééééééééééééééé"),
    (None, "éééééééééééééééééééé\nééééééééééééééééééé"),
    (None, None),
    (9, ""),
]


def test_ties_repeated_rows_and_short_keys(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    result = got(df)
    assert result == brute_force(texts_of(df))
    by_id = defaultdict(list)
    for i, _, dropped, text in result:
        by_id[i].append((dropped, text))
    assert by_id[1] == [(2, "own line of the first one, long enough")]
    assert by_id[2] == [(1, "")]
    assert sorted(d for d, _ in by_id[3]) == [0, 0]  # the largest holder keeps all of its lines
    assert by_id[4] == [(0, "Ünderline thät ıs shared by thrée")] * 2  # two documents: A-Z are lower-cased only
    assert by_id[7] == [(1, "ééééééééééééééééééé")]  # 20 code points are enough, 19 are not
    assert by_id[9] == [(0, "")]


def test_a_task_keeps_few_documents_of_a_line(spark):
    """A line of every document leaves a task as ``min_docs`` rows, however many documents it saw."""
    df = spark.range(4000).selectExpr("id AS owner", f"'{SHARED}' AS text").coalesce(2)
    held = lines.last_documents(df, 20, 3).collect()
    assert len(held) <= 2 * 3
    handed_on = lines.last_documents(df, 20, 3, keys_at_once=1).collect()
    assert len(handed_on) > 6 and max(r["owner"] for r in handed_on) == 3999
    shared = lines.shared_lines(df, 20, 3).collect()
    assert [r["keeper"] for r in shared] == [3999]


def test_a_very_long_text(spark):
    long = "\n".join(f"line number {i} of a very long text" for i in range(30_000))
    assert len(long) > 1_000_000
    df = spark.createDataFrame([(i, long) for i in (1, 2, 3)], "doc_id long, text string")
    result = got(df)
    assert [(i, n, dropped) for i, n, dropped, _ in result] == [(1, 30_000, 30_000), (2, 30_000, 30_000), (3, 30_000, 0)]
    assert result[2][3] == long
