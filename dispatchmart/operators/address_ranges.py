"""Coordinates of any house number of a street, from ranges of numbers; streets with spelling mistakes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchmart.operators.geocode import PLACE_KEY
from dispatchmart.operators.joins import BROADCAST_ROWS, spread_join
from dispatchmart.session import checkpoint_dir

STREET = ["street", "city", "state"]
GRAM = 2
MAX_EDITS = 2
_NUMBER = r"^\s*(\d+)\s+(\S.*?)\s*$"


def house_number(address: Column) -> Column:
    """The number an address begins with, NULL without one or with one beyond any street."""
    digits = F.regexp_extract(address, _NUMBER, 1)
    return F.when(F.length(digits).between(1, 9), digits.cast("long"))


def street_name(address: Column) -> Column:
    """The address without its number."""
    name = F.regexp_extract(address, _NUMBER, 2)
    return F.when(name != "", name).otherwise(F.trim(address))


def in_ranges(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """``addresses`` (street, city, state, number) that a range covers, with the coordinates interpolated in it.

    ``ranges`` has street, city, state, ``house_from``, ``house_to``, ``side`` (odd, even or both) and the coordinates of its ends.
    Of several ranges the shortest counts, then the one that starts first, then the least coordinates.

    A range belongs to the level of the power of two that holds its length, and there to at most two blocks; an
    address is asked for once at every level that has ranges. So the join is on equal keys, a long street is
    cut into its blocks, and a long range costs no more rows than a short one.
    """
    coordinates = ["latitude_from", "longitude_from", "latitude_to", "longitude_to"]
    valid = ranges.where("house_from >= 0 AND house_to >= house_from").select(
        *STREET,
        F.col("house_from").cast("long").alias("house_from"),
        F.col("house_to").cast("long").alias("house_to"),
        "side",
        *[F.col(c).cast("double").alias(c) for c in coordinates],
    )
    more = F.col("house_to") - F.col("house_from")
    placed = valid.withColumn("_level", F.when(more == 0, 0).otherwise(F.length(F.bin(more))))
    block = F.sequence(F.expr("shiftright(house_from, _level)"), F.expr("shiftright(house_to, _level)"))
    placed = placed.withColumn("_block", F.explode(block))
    there = placed.agg(F.coalesce(F.array_sort(F.collect_set("_level")), F.array().cast("array<int>"))).scalar()
    asked = addresses.select(*STREET, "number").where(F.col("number").isNotNull()).withColumn("_level", F.explode(there))
    asked = asked.withColumn("_block", F.expr("shiftright(number, _level)"))
    met = asked.join(placed, [*STREET, "_level", "_block"])
    number, low, high = F.col("number"), F.col("house_from"), F.col("house_to")
    side = F.col("side")
    on_side = (side == "both") | ((side == "odd") & (number % 2 == 1)) | ((side == "even") & (number % 2 == 0))
    met = met.where(number.between(low, high) & on_side)
    best = F.min(F.struct((high - low).alias("length"), "house_from", *coordinates)).alias("_best")
    found = met.groupBy(*STREET, "number").agg(best)
    share = (number - F.col("_best.house_from")) / F.greatest(F.col("_best.length"), F.lit(1))

    def between(name: str) -> Column:
        start, end = F.col(f"_best.{name}_from"), F.col(f"_best.{name}_to")
        return (start + (end - start) * share).alias(name)

    return found.select(*STREET, "number", between("latitude"), between("longitude"))


def _middle(ranges: DataFrame, by: list[str]) -> DataFrame:
    """The middle of what the ranges of a street or a city span."""

    def half(name: str) -> Column:
        ends = F.least(F.min(f"{name}_from"), F.min(f"{name}_to")), F.greatest(F.max(f"{name}_from"), F.max(f"{name}_to"))
        return ((ends[0].cast("double") + ends[1].cast("double")) / 2).alias(name)

    return ranges.groupBy(*by).agg(half("latitude"), half("longitude"))


def locate_by_range(pickups: DataFrame, ranges: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``latitude``, ``longitude`` and ``precision`` of each pickup's address.

    The house number is looked for in the ranges of its street; else the middle of the street counts, else that of the
    city (``precision`` number, street, city or NULL). Each address is looked up once, however many pickups it has, and
    the join back to the pickups splits those that have very many.
    """
    address = F.col("street_address")
    distinct = pickups.select(PLACE_KEY).distinct()
    parted = distinct.withColumns({"street": street_name(address), "number": house_number(address)})
    exact = in_ranges(parted.select(*STREET, "number").distinct(), ranges)
    exact = exact.select(*STREET, "number", F.struct("latitude", "longitude").alias("_exact"))
    streets = _middle(ranges, STREET).select(*STREET, F.struct("latitude", "longitude").alias("_street"))
    cities = _middle(ranges, STREET[1:]).select(*STREET[1:], F.struct("latitude", "longitude").alias("_city"))
    located = parted.join(exact, [*STREET, "number"], "left").join(streets, STREET, "left")
    located = spread_join(located, cities, STREET[1:], "left", max_rows, bound=ranges)
    place = F.coalesce("_exact", "_street", "_city")
    precision = (
        F.when(F.col("_exact").isNotNull(), "number")
        .when(F.col("_street").isNotNull(), "street")
        .when(F.col("_city").isNotNull(), "city")
    )
    known = located.select(*PLACE_KEY, place.alias("_geo"), precision.alias("precision")).where(F.col("_geo").isNotNull())
    joined = spread_join(pickups, known, PLACE_KEY, "left", max_rows)
    return joined.select(*pickups.columns, "_geo.*", "precision")


def _grams(name: Column) -> Column:
    """The overlapping grams of a name with marked ends, each with how many equal ones came before."""
    marked = F.concat(F.lit("\x02" * (GRAM - 1)), name, F.lit("\x03" * (GRAM - 1)))
    cut = F.transform(F.sequence(F.lit(1), F.length(name) + GRAM - 1), lambda i: F.substring(marked, i, F.lit(GRAM)))
    earlier = lambda gram, i: F.size(F.filter(F.slice(cut, F.lit(1), i), lambda g: g == gram))
    return F.transform(cut, lambda gram, i: F.struct(gram.alias("gram"), earlier(gram, i).alias("nth")))


def _shortened(name: Column, edits: int) -> Column:
    """The name and whatever is left of it when up to ``edits`` characters are taken out."""

    def without_one(text: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))

    left = F.array(name)
    for _ in range(edits):
        left = F.array_distinct(F.concat(left, F.flatten(F.transform(left, without_one))))
    return left


def _tokens(names: DataFrame, name: str, within: list[str], counts: DataFrame, edits: int) -> DataFrame:
    """The tokens a name is looked up by: its rarest grams, or for a very short one what deletions leave."""
    exploded = names.select(*within, name, F.explode(_grams(F.col(name))).alias("_g")).select("*", "_g.*").drop("_g")
    ranked = exploded.join(counts, [*within, "gram", "nth"])
    entry = F.struct("n", "gram", "nth")
    rarest = ranked.groupBy(*within, name).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, edits * GRAM + 1).alias("_rare"))
    long = rarest.select(*within, name, F.explode("_rare").alias("_t"))
    long = long.select(*within, name, F.concat_ws(":", F.col("_t.nth").cast("string"), "_t.gram").alias("token"))
    short = names.where(F.length(name) <= edits * GRAM - GRAM + 1).select(
        *within, name, F.explode(_shortened(F.col(name), edits)).alias("_s")
    )
    return long.unionByName(short.select(*within, name, F.concat(F.lit("-:"), "_s").alias("token")))


def nearest_names(
    wanted: DataFrame, listed: DataFrame, name: str = "street", within: tuple[str, ...] = ("city", "state"), edits: int = MAX_EDITS
) -> DataFrame:
    """For each wanted name the listed one of least edit distance, ``edits`` at most: columns ``nearest`` and ``distance``.

    Ties go to the first name of the alphabet; names without a match are left out. Names meet only ``within`` the same city.

    Names that are so near share one of their rarest ``2 * edits + 1`` grams of two characters, or both are very short (at most three
    characters for two edits) and leave the same rest when up to ``edits`` of them are taken out. Those that
    meet so, and are of similar length, are compared; there is no limit on their number.
    """
    checkpoint_dir(wanted.sparkSession)
    within = list(within)
    asked = wanted.select(*within, name).where(F.col(name).isNotNull()).distinct().checkpoint()
    known = listed.select(*within, F.col(name).alias("_listed")).where(F.col("_listed").isNotNull()).distinct().checkpoint()
    every = asked.unionByName(known.withColumnRenamed("_listed", name))
    counts = every.select(*within, F.explode(_grams(F.col(name))).alias("_g")).groupBy(*within, "_g.gram", "_g.nth").agg(F.count("*").alias("n")).checkpoint()
    left = _tokens(asked, name, within, counts, edits)
    right = _tokens(known, "_listed", within, counts, edits)
    # A frequent token has many names on either side; adaptive execution splits what is too large for a task.
    pairs = left.join(right, [*within, "token"])
    near = F.abs(F.length(name) - F.length("_listed")) <= edits
    pairs = pairs.where(near).select(*within, name, "_listed").distinct()
    distance = F.levenshtein(F.col(name), F.col("_listed"), edits)
    best = pairs.withColumn("_d", distance).where("_d >= 0").groupBy(*within, name).agg(F.min(F.struct("_d", "_listed")).alias("_b"))
    return best.select(*within, name, F.col("_b._listed").alias("nearest"), F.col("_b._d").alias("distance"))
