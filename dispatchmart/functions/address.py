"""Street, city and state rules.

Every function takes columns and returns a column, and NULL stays NULL. Rules about
words take the array that ``words`` makes, so that a plan cuts a text once. Where the
corrected rule differs from the rule that older loads were made with,
``compat=True`` gives the older result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V
from dispatchmart.functions.columns import recode, replace_all

_MARK = "\u0001"


def words(text: Column) -> Column:
    """Text cut at white space, without empty pieces."""
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")


def _joined(pieces: Column) -> Column:
    return F.array_join(pieces, " ")


def shorten_street_type(address: Column) -> Column:
    """Shorten a street type that ends the address after a space.

    Only the last word can match and no short form is itself a long form, so one
    lookup does the work of a chain of anchored replacements.
    """
    last = F.substring_index(address, " ", -1)
    short = recode(last, V.STREET_TYPES)
    kept = F.substring(address, F.lit(1), F.length(address) - F.length(last))
    return F.when(address.contains(" ") & short.isNotNull(), F.concat(kept, short)).otherwise(address)


def add_suburb(address: Column, location: Column) -> Column:
    """Append the suburb that precedes a suburb code in the location text."""
    suburb = F.substring(location, F.lit(1), F.greatest(F.length(location) - 2, F.lit(0)))
    return F.when(
        F.substring(location, -2, 2).isin(*V.SUBURB_CODES), F.concat(address, F.lit(" "), suburb)
    ).otherwise(address)


def location_code(location: Column) -> Column:
    return F.trim(F.substring(location, -2, 2))


def location_state(code: Column, otherwise: Column) -> Column:
    return recode(code, V.LOCATION_STATES, otherwise)


def location_city(code: Column, compat: bool = False) -> Column:
    """City named by a location code, airports included.

    The corrected rule matches whole codes; ``compat`` also rewrites codes that
    merely contain one (``MA`` gives ``MANHATTANA``).
    """
    if compat:
        city = F.when(code.isin(*V.CITYLESS_CODES), F.lit("")).otherwise(code)
        return replace_all(replace_all(city, V.BOROUGHS), V.AIRPORT_CITIES)
    blanks = dict.fromkeys(V.CITYLESS_CODES, "")
    return recode(code, {**blanks, **V.BOROUGHS, **V.AIRPORT_CITIES}, code)


def blank_city_outside(city: Column, state: Column) -> Column:
    return F.when(state.isin(*V.CITYLESS_STATES), F.lit("")).otherwise(city)


def airport_by_location(address: Column, location: Column) -> Column:
    return recode(location, V.AIRPORT_BY_LOCATION, address)


def airport_by_word(first: Column, address: Column) -> Column:
    """Airport address when the first word contains an airport code."""
    hit = F.coalesce(
        *[F.when(first.contains(code), F.lit(place)) for code, place in V.AIRPORT_BY_WORD.items()]
    )
    return F.coalesce(hit, address)


def airport_field(code: Column, field: int, otherwise: Column) -> Column:
    """One field of the airport table: 0 street, 1 house number, 2 state, 3 city."""
    return recode(code, {key: row[field] for key, row in V.AIRPORT_BY_CODE.items()}, otherwise)


def remove_cross_street(pieces: Column) -> Column:
    """Blank ``ON`` and the cross street after it.

    The second word after ``ON`` goes; the first one stays only when it is all
    letters. Both are left alone when fewer than two words follow.
    """

    marks = F.array_compact(F.transform(pieces, lambda word, i: F.when(word == "ON", i)))
    # An ON two words after one that counts is blanked by it; any other counts, also right after one.
    counting = F.aggregate(
        marks,
        F.array().cast("array<int>"),
        lambda kept, at: F.when(F.array_contains(kept, at - 2), kept).otherwise(F.array_append(kept, at)),
    )

    def blanked(at: Column) -> Column:
        def rule(word: Column, i: Column) -> Column:
            first = F.array_contains(at, i - 1) & (i + 1 < F.size(pieces)) & ~word.rlike(r"^\p{L}+$")
            gone = F.array_contains(at, i) | F.array_contains(at, i - 2) | first
            return F.when(gone, F.lit("")).otherwise(word)

        return F.transform(pieces, rule)

    # As the element of a list the places are found once, not again for every word.
    once = F.element_at(F.transform(F.array(counting), blanked), 1)
    return F.when(F.array_contains(pieces, "ON"), _joined(once)).otherwise(_joined(pieces))


def ordinal_words(address: Column, compat: bool = False) -> Column:
    """Number words to ordinals, wherever they occur."""
    table = V.ORDINAL_WORDS if compat else {**V.ORDINAL_WORDS, **V.ADDED_ORDINAL_WORDS}
    return replace_all(address, table)


def address_tail(address: Column) -> Column:
    """Last three characters, where free-text addresses name the city."""
    return F.substring(address, -3, 3)


def before_comma(address: Column) -> Column:
    return F.substring_index(address, ",", 1)


def cut_after_street_type(pieces: Column, compat: bool = False) -> Column:
    """Keep the words up to the first street type.

    Without a street type the last word (the city) is dropped. ``compat`` drops the
    last word also when the address ends in its street type.
    """
    count = F.size(pieces)
    hits = F.transform(pieces, lambda word, i: F.when(word.isin(*V.CUTTING_STREET_TYPES), i + 1))
    upto = F.array_min(hits)
    if compat:
        upto = F.nullif(upto, count)
    return _joined(F.slice(pieces, F.lit(1), F.coalesce(upto, F.when(count > 1, count - 1).otherwise(count))))


def drop_new(address: Column) -> Column:
    return F.replace(address, F.lit("NEW"), F.lit(" "))


def fragment_city(fragment: Column, compat: bool = False) -> Column:
    """City named by the last three characters of an address.

    ``compat`` leaves spaces in place and reads ``NY.`` as NY and any character.
    """
    if not compat:
        code = F.trim(fragment)
        return recode(code, V.FRAGMENT_CITIES, code)
    names = V.FRAGMENT_CITIES
    city = replace_all(fragment, {key: names[key] for key in ("ONX", "BX")})
    city = recode(city, {key: names[key] for key in ("NYC", "NY", "ORK")}, city)
    city = replace_all(city, {"QU": names["QU"]})
    city = F.regexp_replace(city, "NY.", names["NY."])
    return replace_all(city, {"LYN": names["LYN"]})


def from_first_digit(address: Column) -> Column:
    """Drop what precedes the first digit; text without digits stays."""
    return F.regexp_replace(address, "(?s)^[^0-9]*([0-9].*)$", "$1")


def _suffix(suffix: str, compat: bool) -> str:
    return suffix.lower() if compat else suffix


def ordinal_after_compass(pieces: Column, compat: bool = False) -> Column:
    """``W 45`` to ``W 45TH``; repeated spaces collapse. ``compat`` writes ``45th``."""

    def with_suffix(word: Column, i: Column) -> Column:
        last = F.substring(word, -1, 1)
        suffix = F.when(word.rlike("1[123]$"), F.lit(_suffix(V.OTHER_ORDINAL, compat))).otherwise(
            recode(
                last,
                {digit: _suffix(text, compat) for digit, text in V.ORDINAL_SUFFIXES.items()},
                F.lit(_suffix(V.OTHER_ORDINAL, compat)),
            )
        )
        follows = F.get(pieces, i - 1).isin(*V.COMPASS_LETTERS)
        return F.when((i > 0) & follows & word.rlike("^[0-9]+$"), F.concat(word, suffix)).otherwise(word)

    return _joined(F.transform(pieces, with_suffix))


def ordinal_digit_runs(street: Column, compat: bool = False) -> Column:
    """Ordinal suffix after each digit run that something follows.

    The character after the run gives way to the suffix and a space. Runs that
    already carry a suffix are left alone, except under ``compat``, which also
    writes the suffixes in lower case.
    """
    present = "|".join([*V.ORDINAL_SUFFIXES.values(), V.OTHER_ORDINAL])
    skip = "" if compat else rf"(?!(?:{present})\b)"
    text = F.regexp_replace(street, rf"(?<=\d){skip}\D", _MARK)
    for digit, suffix in V.ORDINAL_SUFFIXES.items():
        text = F.regexp_replace(text, rf"(?<=(?<!1){digit}){_MARK}", f"{_suffix(suffix, compat)} ")
    return F.replace(text, F.lit(_MARK), F.lit(f"{_suffix(V.OTHER_ORDINAL, compat)} "))


def state_code(state: Column) -> Column:
    return F.left(state, F.lit(2))


def state_name(code: Column, otherwise: Column) -> Column:
    return recode(code, V.STATE_NAMES, otherwise)


def full_street(house: Column, street: Column) -> Column:
    return F.concat(house, F.lit(" "), street)
