"""Cleaning and classing of map attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Storey heights, the height of unknown buildings, heights by type (metres).
STOREY, TALL_STOREY, UNKNOWN_HEIGHT = 3.2, 4.2, 10.0
TALL_TYPES = ["university", "hospital", "church", "school", "public"]


def parse_number(text: Column) -> Column:
    """Number in text such as "12,5 m"; null if it is none."""
    return F.try_cast(F.trim(F.replace(F.replace(text, F.lit("m"), F.lit("")), F.lit(","), F.lit("."))), "double") if hasattr(F, "try_cast") else F.trim(F.replace(F.replace(text, F.lit("m"), F.lit("")), F.lit(","), F.lit("."))).try_cast("double")


def present(x: Column) -> Column:
    """The value, null for 0 and NaN, which stand for missing."""
    return F.when((x != 0) & ~F.isnan(x), x)


def first_match(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """Label of the first rule that holds; a null test does not hold."""
    out = F.lit(default)
    for test, label in reversed(rules):
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def fallback_height(height: Column, levels: Column, kind: Column, by_kind: dict[str, float]) -> Column:
    """Height above 2 m, or from the storeys, or by type, or the unknown height."""
    per = F.when(kind.isin(TALL_TYPES), TALL_STOREY).otherwise(STOREY)
    table = F.create_map(*[F.lit(v) for kv in by_kind.items() for v in kv])
    return F.coalesce(F.when(height > 2, height), F.when(levels > 0, levels * per + 1), F.try_element_at(table, kind), F.lit(UNKNOWN_HEIGHT))


def floors(levels: Column, height: Column) -> Column:
    """Storeys; from the height where they are missing or 0, one at least (halves to even)."""
    return F.coalesce(present(levels), F.greatest(F.lit(1.0), F.bround(height / 4)))


#: Tags of green ground, highways that people walk, and what a metre of a kind costs them.
GREEN_LANDUSE = ["grass", "meadow", "village_green", "flowerbed", "forest", "recreation_ground", "cemetery", "greenfield", "vineyard", "orchard", "allotments"]
GREEN_LEISURE = ["park", "garden", "dog_park", "playground", "golf_course"]
GREEN_NATURAL = ["wood", "scrub", "grassland"]
WALKED = ["footway", "path", "pedestrian", "steps", "corridor", "living_street", "residential", "service", "unclassified", "tertiary", "secondary", "primary", "cycleway", "track", "crossing", "elevator"]
STEPS_COST = 1.4


def _tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def ground_class(tags: Column) -> Column:
    """water, sport, grass or asphalt (car parks) of a land area; null for others."""
    landuse, leisure, natural = (_tag(tags, k) for k in ("landuse", "leisure", "natural"))
    none = F.lit(False)
    water = F.coalesce(natural == "water", none) | F.coalesce(leisure == "swimming_pool", none) | F.coalesce(landuse == "basin", none)
    grass = F.coalesce(landuse.isin(GREEN_LANDUSE), none) | F.coalesce(leisure.isin(GREEN_LEISURE), none) | F.coalesce(natural.isin(GREEN_NATURAL), none)
    return first_match([(water, "water"), (leisure.isin("pitch", "track"), "sport"), (grass, "grass"), (_tag(tags, "amenity") == "parking", "asphalt")])


def stop_kind(tags: Column) -> Column:
    """metro, train, metro_entrance, tram, bus or entrance (of a building); null for other nodes."""
    railway = _tag(tags, "railway")
    metro = F.coalesce(_tag(tags, "station") == "subway", F.lit(False)) | ((railway == "station") & (_tag(tags, "subway") == "yes"))
    return first_match([(metro, "metro"), (railway.isin("station", "halt"), "train"), (railway == "subway_entrance", "metro_entrance"), (railway == "tram_stop", "tram"), (_tag(tags, "highway") == "bus_stop", "bus"), (_tag(tags, "entrance").isNotNull(), "entrance")])


def walkable(tags: Column) -> Column:
    """Ways that people walk: of a walked kind, neither barred on foot nor at all."""
    barred = [F.coalesce(_tag(tags, k), F.lit("")) == "no" for k in ("foot", "access")]
    return F.coalesce(_tag(tags, "highway").isin(WALKED), F.lit(False)) & ~barred[0] & ~barred[1]


def covered(tags: Column) -> Column:
    """Tunnels, covered ways and ways indoors."""
    return (F.coalesce(_tag(tags, "tunnel"), F.lit("no")) != "no") | (F.coalesce(_tag(tags, "covered"), F.lit("no")) != "no") | (F.coalesce(_tag(tags, "indoor"), F.lit("")) == "yes")


def cost_factor(highway: Column) -> Column:
    return F.when(highway == "steps", STEPS_COST).otherwise(1.0)


def mentions(tags: Column, words: list[str], numbered: str | None = None) -> Column:
    """Whether any value has one of the words, or the word `numbered` and a digit; case does not count."""
    text = F.lower(F.concat_ws(" ", F.map_values(tags)))
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w.lower())
    return out | (text.contains(numbered.lower()) & text.rlike("[0-9]")) if numbered else out
