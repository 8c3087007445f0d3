"""URL filtering by host and path rules, and by a list of keys held in a cascade of Bloom filters.

The first filter of the cascade encodes the listed keys. Unlisted keys of the corpus that pass it by mistake are encoded in the
second, listed keys that pass that one in the third, and so on until none is left. All keys of the corpus
took part, so the first filter that a key of the corpus does not pass tells exactly whether it is listed: membership
is looked up in bits, without a join. A list too long for filters of a bounded size is divided by a hash of the
key into parts with cascades of their own, and the table is read once for each part.

DataFrame functions only. Defined results: a null URL, or one without ``://``, has an empty host and path, which is a
key like any other; repeated rows and keys get equal verdicts, each row is kept; an empty list lists nothing; an empty
table gives an empty one; all columns are kept, added ones replace columns of their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm.common import saved

BITS_PER_KEY = 10
HASHES = 4
MAX_FILTER_BITS = 1 << 25
"""Bits of one filter, and thereby the size of what is sent to every task."""

MAX_LEVELS = 64

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``address`` is a host and the start of a path, such as ``example.org/en/``; subdomains are included."""

    verdict: str
    address: str

    @property
    def host(self) -> str:
        return self.address.partition("/")[0]

    @property
    def path(self) -> str:
        return self.address[len(self.host) :]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path of a URL; both empty when it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as ``rule, verdict``; null when none does. ``rules`` is a short list."""
    cases = None
    for rule in sorted(rules, key=lambda r: (-len(r.address), r.address)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.address).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if cases is None else cases


class Cascade:
    """Filters over the keys of a corpus; ``listed(key)`` is exact for every one of these keys."""

    def __init__(self, filters: DataFrame, sizes: list[int], parts: int):
        self._filters, self._sizes, self.parts = filters, sizes, parts

    def part(self, key: Column) -> Column:
        return _part(key, self.parts)

    def listed(self, key: Column, part: int = 0) -> Column:
        """Whether ``key``, which belongs to ``part``, is listed."""
        found = F.lit(len(self._sizes) % 2 == 1)  # passes all filters
        for level in range(len(self._sizes), 0, -1):
            one = self._filters.where((F.col("level") == level) & (F.col("part") == part))
            words = one.select("words").scalar()
            found = F.when(_passes(key, level, self._sizes[level - 1], words), found).otherwise(F.lit(level % 2 == 0))
        return found


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)).cast("int")


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """The bits of ``key`` in the filter of a level; each level has hashes of its own."""
    hashes = [F.xxhash64(F.lit(level * HASHES + j), key) for j in range(HASHES)]
    return [F.pmod(h, F.lit(bits)) for h in hashes]


def _passes(key: Column, level: int, bits: int, words: Column) -> Column:
    def is_set(at: Column) -> Column:
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return reduce(lambda a, b: a & b, [is_set(at) for at in _positions(key, level, bits)])


def _build(encoded: DataFrame, level: int, bits: int, parts: int) -> DataFrame:
    """``level, part, words`` with the bits of all keys of ``encoded``; parts have at most ``MAX_FILTER_BITS``."""
    spark = encoded.sparkSession
    at = encoded.select("part", F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
    word = F.shiftright("at", 6).cast("int")
    bit = F.expr("shiftleft(1L, CAST(at & 63L AS INT))")
    clear = spark.range(parts * (bits // 64)).select(
        F.pmod("id", F.lit(parts)).cast("int").alias("part"),
        F.floor(F.col("id") / parts).cast("int").alias("i"),
        F.lit(0).cast("long").alias("word"),
    )
    words = at.select("part", word.alias("i"), bit.alias("word")).unionByName(clear)
    words = words.groupBy("part", "i").agg(F.bit_or("word").alias("word"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda w: w["word"])
    return words.groupBy("part").agg(in_order.alias("words")).select(F.lit(level).alias("level"), "part", "words")


def build_cascade(listed: DataFrame, corpus: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> Cascade:
    """A cascade for the keys of ``listed`` over those of ``corpus``; both have one column ``key``.

    Keys that only the list has take part like those of the corpus. Null keys are in neither.
    """
    flagged = corpus.select("key", F.lit(False).alias("listed")).unionByName(
        listed.select("key", F.lit(True).alias("listed"))
    )
    # One grouped flag instead of a join: copies of a key collapse before the shuffle.
    keys = saved(flagged.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("encode")))
    n = keys.where("encode").count()
    parts = max(1, -(-n * BITS_PER_KEY // max_filter_bits))
    alive = keys.withColumn("part", _part(F.col("key"), parts))
    filters, sizes = None, []
    while n:
        level = len(sizes) + 1
        if level > MAX_LEVELS:
            raise RuntimeError(f"{n} keys are left after {MAX_LEVELS} levels")
        most = alive.where("encode").groupBy("part").count().agg(F.max("count")).first()[0]
        bits = max(64, -(-most * BITS_PER_KEY // 64) * 64)
        built = saved(_build(alive.where("encode"), level, bits, parts))
        filters = built if filters is None else filters.unionByName(built)
        sizes.append(bits)
        passing = F.lit(False)
        for part in range(parts):
            words = built.where(F.col("part") == part).select("words").scalar()
            passing = F.when(F.col("part") == part, _passes(F.col("key"), level, bits, words)).otherwise(passing)
        # What was encoded stays, to be told from the false positives that are encoded next.
        alive = saved(
            alive.withColumn("_next", ~F.col("encode") & passing)
            .where("encode OR _next")
            .select("key", F.col("_next").alias("encode"), "part")
        )
        n = alive.where("encode").count()
    return Cascade(filters, sizes, parts)


def with_address(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path`` and their concatenation ``key``."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    return pages.withColumns({"host": host, "path": path}).withColumn("key", F.concat("host", "path"))


def judge(addressed: DataFrame, rules: list[Rule], cascade: Cascade) -> DataFrame:
    """``rule``, ``listed`` and ``verdict`` of every row of ``with_address``: the best rule's, else the list's."""
    rows = addressed.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))

    def judged(part: DataFrame, number: int) -> DataFrame:
        part = part.withColumn("listed", cascade.listed(F.col("key"), number))
        by_list = F.when(F.col("listed"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
        return part.withColumns(
            {"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", by_list)}
        ).drop("_best")

    if cascade.parts == 1:
        return judged(rows, 0)
    of = cascade.part(F.col("key"))
    return reduce(DataFrame.unionByName, [judged(rows.where(of == p), p) for p in range(cascade.parts)])
