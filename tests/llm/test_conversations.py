import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from dispatchmart.llm import conversations as C
from dispatchmart.llm import viterbi as V

WORD = re.compile(r"[^\x20\x09-\x0D]")
RIGHT = re.compile(r"(s?(ua)+)?\Z")


def slow_damage(rows):
    """``conv_id, turn, role, text`` after damage; conversations are listed beside them."""
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(key.encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def slow_repair(rows):
    """One conversation by the definition: the least of (cost, audit) over all ways to edit it."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)

    def fits(made, letter):
        made += letter
        return RIGHT.match(made) or RIGHT.match(made + "a") or RIGHT.match(made + "ua")

    @lru_cache(maxsize=None)
    def best(i, made, inserted):
        """From row i on, with initials made so far (one ``ua`` less makes no difference)."""
        ways = []
        if i == len(rows) and RIGHT.match(made):
            ways.append((0, "", ()))
        short = lambda m: m if len(m) < 4 else m.replace("ua", "", 1)
        if inserted < 3:
            for name in ("user", "assistant"):
                if fits(made, name[0]):
                    cost, audit, turns = best(i, short(made + name[0]), inserted + 1)
                    ways.append((cost + 2, "I" + audit, ((name, ""), *turns)))
        if i < len(rows):
            role, text = rows[i][2:]
            cost, audit, turns = best(i + 1, made, 0)
            ways.append((cost + 3, "D" + audit, turns))
            if faults[i] in ("", "truncated"):
                more = int(faults[i] == "truncated")
                for edit, name, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if name and fits(made, name[0]):
                        cost, audit, turns = best(i + 1, short(made + name[0]), 0)
                        ways.append((cost + price + more, edit + audit, ((name, text), *turns)))
        return min(ways, default=(1 << 40, "", ()))

    cost, audit, turns = best(0, "", 0)
    numbers = {r[1] for r in rows} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    lines = "\n".join(f"{role}:{text}" for role, text in turns)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest(), turns)


def expected(rows, listed):
    by_conv = defaultdict(list)
    for row in rows:
        by_conv[row[0]].append(row)
    return {conv: slow_repair(by_conv[conv]) for conv in listed}


def compare(df, **options):
    """All columns and turns of the repair against the slow one, after damage."""
    given = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = expected(slow_damage(given), {r[0] for r in given})
    repaired = C.repair(C.damaged(df), **options)
    got = {r[0]: tuple(r)[1:] for r in repaired.conversations.collect()}
    assert got == {conv: row[:8] for conv, row in want.items()}
    turns = defaultdict(list)
    for r in sorted(repaired.turns.collect(), key=lambda r: (r["at"], r["i"])):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert {conv: tuple(t) for conv, t in turns.items()} == {conv: row[8] for conv, row in want.items() if row[8]}


SCHEMA = "conv_id long, turn long, role string, text string, at long, code int, k long, cost long, whole boolean"
TEXTS = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "Yes.", None, "So it is. ", "“Quoted.”", "日本。", "a ", "Said.\n\nMore.\r\n"]
ROLES = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "umpire", "USER"]


def drawn(spark, seed, sizes):
    draw, rows = random.Random(seed), []
    for conv, size in enumerate(sizes):
        conv = None if conv == 3 else conv - 2
        for turn in range(size):
            turn = None if draw.random() < 0.05 else turn + draw.choice([0, 0, 0, 5])
            rows.append((conv, turn, draw.choice(ROLES), draw.choice(TEXTS), *[None] * 5))
        if rows and draw.random() < 0.3:
            rows.append(rows[-1])
    return spark.createDataFrame(rows, SCHEMA)


def slow_core(codes):
    """Least cost and audit over every way to edit some rows, tried one by one."""
    gaps = [tuple(p) for n in range(3) for p in itertools.product("ua", repeat=n)]
    best = None
    for choice in itertools.product(*(["D"] if c // 4 > 1 else ["D", "K", "Ru", "Ra"] for c in codes)):
        for put in itertools.product(gaps, repeat=len(codes) + 1):
            made, audit, cost = "".join(put[0]), "I" * len(put[0]), 2 * len(put[0])
            for code, edit, more in zip(codes, choice, put[1:]):
                made += {"D": "", "K": "suaX"[code % 4]}.get(edit, edit[-1])
                cost += {"D": 3, "K": 0}.get(edit, 2) + (edit != "D" and code // 4 == 1)
                made, audit, cost = made + "".join(more), audit + edit[0] + "I" * len(more), cost + 2 * len(more)
            if RIGHT.match(made):
                best = min(best or (cost, audit), (cost, audit))
    return best


def core(codes):
    after, costs, total = V.backward(bytes(codes), V.FINAL)
    steps = V.trace(bytes(codes), after, 0)
    end = V.ending(steps[-1].state if steps else 0)
    return total + costs[0], "".join(s.audit for s in steps) + "I" * len(end)


def test_core_against_all_edits():
    for n in range(3):
        for codes in itertools.product([0, 1, 2, 3, 5, 6, 8], repeat=n):
            assert core(codes) == slow_core(codes), codes
    draw = random.Random(1)
    for _ in range(3):
        codes = draw.choices([0, 1, 2, 3, 4, 5, 6, 14], k=3)
        assert core(codes) == slow_core(codes), codes


def test_rerun_equals_a_run_from_the_right_end():
    draw = random.Random(2)
    for _ in range(500):
        codes = bytes(draw.choices([0, 1, 1, 2, 2, 3, 5, 6, 9, 13, 16], k=draw.randint(1, 12)))
        _, other, _ = V.backward(bytes(draw.choices(range(16), k=5)), V.FINAL)
        _, start, off = V.backward(codes, V.FINAL)
        fresh, grown = V.rerun(codes, V.FINAL, other)
        assert (fresh or start, off + grown) == V.backward(codes, other)[1:]


@pytest.mark.parametrize("seed", [1, 2])
def test_drawn_conversations(spark, seed):
    compare(drawn(spark, seed, random.Random(seed).choices(range(1, 15), k=60)))


@pytest.mark.parametrize("slice_bits", [0, 2])
def test_conversations_cut_into_slices(spark, slice_bits):
    """Slices of one and of four rows, conversations over several ranges."""
    compare(drawn(spark, 3, [40, 1, 3, 25, 60]), held_rows=2, slice_bits=slice_bits)


def test_slices_whose_costs_do_not_converge(spark):
    """Rows of one role only: what the end asks for is felt at the very beginning."""
    rows = [(1, turn, "user", f"Turn {turn}.", *[None] * 5) for turn in range(101)]
    rows += [(2, turn, "user", "Same.", *[None] * 5) for turn in range(80)]
    compare(spark.createDataFrame(rows, SCHEMA), held_rows=2, slice_bits=1)


def test_given_conversations(spark, sf_dir):
    compare(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def test_empty_table_and_nulls(spark):
    compare(spark.createDataFrame([], SCHEMA))
    compare(spark.createDataFrame([(None, None, None, None, *[None] * 5)] * 3, SCHEMA))
    names = [f"{c}:{t}" for c in range(200) for t in [0]]
    dropped = next(c for c, name in enumerate(names) if zlib.crc32(name.encode()) % 20 == 0)
    compare(spark.createDataFrame([(dropped, 0, "user", "All rows dropped.", *[None] * 5)], SCHEMA))


def test_a_very_long_text(spark):
    text = "word " * 250_000 + "end."
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "assistant", text)]
    got = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).conversations.collect()
    assert [(r["duplicate"], r["audit"]) for r in got] == [(1, "KKD")]
    assert got[0]["repaired_sha256"] == hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest()
