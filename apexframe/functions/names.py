"""Names, keys, colours and labels (FN7-FN10, FN19, FN21, FN22, FN25, PRJ22, PRJ23, PRJ26, PRJ27)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Value of a small fixed table; ``default`` (or null) for other keys."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def normalize_team(c: Column, spellings: dict[str, list[str]] | None = None, mode: str = "substring") -> Column:
    """Standard team name by ordered, case-insensitive rules; first hit wins, else the trimmed input (FN7).

    ``mode="substring"`` tests whether a spelling occurs anywhere in the name. ``mode="token"`` only
    accepts whole words, so that "Williams" is not taken for a team abbreviated "AM".
    """
    name = F.trim(c)
    lowered = F.lower(name)
    chain = F.when(c.isNull() | (c == ""), F.lit("Unknown"))
    for standard, variants in (spellings or K.TEAM_SPELLINGS).items():
        if mode == "substring":
            hits = [lowered.contains(v.lower()) for v in variants]
        else:
            hits = [lowered.rlike(rf"(^|\W){v.lower()}($|\W)") for v in variants]
        chain = chain.when(_any(hits), F.lit(standard))
    return chain.otherwise(name)


def normalize_driver(c: Column, names: dict[str, str] | None = None) -> Column:
    """Full name from a code, else from the first full name containing the input, else the input (FN8)."""
    names = names or K.DRIVER_NAMES
    text = F.trim(c)
    chain = F.when(c.isNull() | (c == ""), F.lit("Unknown"))
    by_code = lookup(names, F.upper(text))
    chain = chain.when(by_code.isNotNull(), by_code)
    for full in names.values():
        chain = chain.when(F.lit(full.lower()).contains(F.lower(text)), F.lit(full))
    return chain.otherwise(text)


def team_of_driver(c: Column, lineup: dict[str, list[str]] | None = None) -> Column:
    """Team a driver is signed to; Unknown when not in the line-up (FN9)."""
    by_driver = {d: team for team, drivers in (lineup or K.LINEUP).items() for d in drivers}
    return lookup(by_driver, normalize_driver(c), F.lit("Unknown"))


def session_name(key: Column) -> Column:
    """Long name of a session key; other text passes through (FN10)."""
    return lookup(K.SESSION_NAMES, F.upper(key), key)


def team_colour(name: Column, team_id: Column | None = None) -> Column:
    """Colour by name fragment, else by team id, else the default (PRJ26)."""
    lowered = F.lower(name)
    chain = None
    for colour, fragments, exact in K.COLOUR_RULES:
        hit = _any([lowered.contains(f) for f in fragments] + [F.trim(lowered) == e for e in exact])
        chain = F.when(hit, colour) if chain is None else chain.when(hit, colour)
    fallback = F.lit(K.DEFAULT_COLOUR)
    if team_id is not None:
        fallback = F.coalesce(lookup(K.COLOUR_BY_ID, team_id.cast("int")), fallback)
    return chain.otherwise(fallback)


def team_colour_exact(name: Column) -> Column:
    """Colour by exact team name, unknown names get the default (PRJ27)."""
    return lookup(K.COLOUR_BY_NAME, name, F.lit(K.COLOUR_BY_NAME["Unknown"]))


def code_and_name(code: Column, name: Column) -> Column:
    return F.concat_ws(" - ", code, name)


def code_and_team(code: Column, team: Column) -> Column:
    return F.format_string("%s (%s)", F.coalesce(code, F.lit("")), F.coalesce(team, F.lit("Unknown")))


def driver_display(code: Column, number: Column) -> Column:
    """``code (number)``, or the code alone when the number is unknown (PRJ23)."""
    return F.when(number.isNotNull(), F.format_string("%s (%s)", code, number)).otherwise(code)


def lap_label(lap: Column, seconds: Column, personal_best: Column) -> Column:
    """``Lap n - m:s (Personal Best)`` (FN19)."""
    shown = F.format_string(
        "Lap %s - %d:%.3f", lap.cast("string"), F.floor(seconds / 60), F.pmod(seconds, F.lit(60.0))
    )
    return F.concat(shown, F.when(personal_best, " (Personal Best)").otherwise(""))


def artifact_class(path: Column) -> Column:
    """image / model / data / other, by suffix and name (FN21)."""

    def ends(*suffixes: str) -> Column:
        return _any([path.endswith(s) for s in suffixes])

    return (
        F.when(ends(".png", ".jpg", ".jpeg"), "images")
        .when(F.lower(path).contains("model"), "models")
        .when(ends(".csv", ".json", ".txt"), "data")
        .otherwise("other")
    )


def safe_name(c: Column) -> Column:
    """Spaces, dashes and slashes to underscores (FN22)."""
    return F.translate(c, " -/", "___")


def title_case(c: Column) -> Column:
    """snake_case to Title Case (FN25)."""
    return F.initcap(F.translate(c, "_", " "))


def without_preseason(df: DataFrame, event: str = "EventName") -> DataFrame:
    """Drop events whose name starts with Pre-Season (PRJ22)."""
    return df.filter(~F.col(event).startswith("Pre-Season"))
