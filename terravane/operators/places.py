"""Places and regional clusters: states, cities, radius joins, density centers, cluster detection and assignment."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import EARTH_RADIUS_MILES, haversine_miles

#: Regions and their states.
REGION_STATES = {
    "northeast": ("CT", "ME", "MA", "NH", "NY", "RI", "VT"),
    "mid_atlantic": ("DE", "MD", "NJ", "PA", "VA", "WV", "DC"),
    "southeast": ("AL", "FL", "GA", "KY", "MS", "NC", "SC", "TN"),
    "midwest_great_lakes": ("IL", "IN", "IA", "KS", "MI", "MN", "MO", "NE", "ND", "OH", "SD", "WI"),
    "south_central_texas_gulf": ("AR", "LA", "OK", "TX"),
    "mountain_west": ("AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY"),
    "west_coast_pacific": ("AK", "CA", "HI", "OR", "WA"),
}
CITY_ALIASES = {"st": "saint", "ft": "fort", "mt": "mount"}
CITY_SUFFIXES = ("city", "town", "village", "borough", "township", "cdp", "municipality")
CORE_MILES, RADIUS_MILES, LEAST_FAMILIES, LEAST_CATEGORIES, DRIFT_MILES = 50.0, 200.0, 10, 5, 25.0


def region_of(state: Column) -> Column:
    """Region code of a two-letter state; null for others."""
    out = F.when(F.lit(False), F.lit(None))
    for region, states in REGION_STATES.items():
        out = out.when(F.upper(F.trim(state)).isin(*states), F.lit(region))
    return out


def normalized_city(city: Column) -> Column:
    """Plain city name, abbreviations spelled out, suffixes taken off until none is left."""
    own = F.transform(T.words(T.plain(city)), lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CITY_ALIASES.items() for x in kv]), w), w))
    return F.regexp_replace(F.array_join(own, " "), f"( ({'|'.join(CITY_SUFFIXES)}))+$", "")


def prepared_locations(rows: DataFrame, key: str, places: str) -> DataFrame:
    """key, position, city, is_primary, failure for every place named: its plain city, the first that has one being primary; a place without a city fails and keeps its position."""
    cities = F.transform(places, normalized_city)
    first = F.array_position(F.transform(cities, lambda c: c != ""), True) - 1
    each = rows.select(key, first.cast("int").alias("_first"), F.posexplode(cities).alias("position", "city"))
    empty = F.col("city") == ""
    return each.select(key, "position", F.when(~empty, F.col("city")).alias("city"), (F.col("position") == F.col("_first")).alias("is_primary"), F.when(empty, "no city").alias("failure"))


def gazetteer_lookup(rows: DataFrame, places: DataFrame, city: str, state: str) -> DataFrame:
    """rows with lat, lon and reason: ok, missing, unknown state, not found or ambiguous. places: city_key, state, lat, lon."""
    held = places.groupBy("city_key", F.col("state").alias("_state")).agg(F.count(F.lit(1)).alias("_n"), F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    keyed = rows.withColumn("city_key", normalized_city(F.col(city))).withColumn("_state", F.upper(F.trim(state)))
    known = places.select(F.col("state").alias("_state")).distinct().withColumn("_known", F.lit(True))
    joined = keyed.join(known, "_state", "left").join(held, ["city_key", "_state"], "left")
    reason = (
        F.when((F.coalesce(F.trim(city), F.lit("")) == "") | F.col(state).isNull(), "missing")
        .when(F.col("_known").isNull(), "unknown state")
        .when(F.col("_n").isNull(), "not found")
        .when(F.col("_n") > 1, "ambiguous")
        .otherwise("ok")
    )
    found = joined.withColumn("reason", reason)
    return found.withColumns({c: F.when(F.col("reason") == "ok", F.col(c)) for c in ("lat", "lon")}).drop("_state", "_known", "_n")


def country(value: Column, aliases: dict[str, str]) -> Column:
    """Canonical country by an alias map without regard to case and marks; the trimmed text otherwise."""
    k = T.plain(value)
    out = F.when(F.lit(False), F.lit(None))
    for alias, name in aliases.items():
        out = out.when(k == alias, F.lit(name))
    return out.otherwise(F.nullif(F.trim(value), F.lit("")))


def radius_join(left: DataFrame, right: DataFrame, miles: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs within a great-circle distance, inclusive, with `miles`. Columns: lat, lon on the left, lat2, lon2 on the right.

    Both sides meet on cells of a grid one radius high; the right side is copied to the cells around its own, so each pair
    meets once. Longitude cells widen with latitude by the band's width at its edge farthest from the equator.
    """
    step = math.degrees(miles / EARTH_RADIUS_MILES) * 1.0001
    band = lambda lat: F.floor((lat + 90) / step).cast("int")

    def cells(b):
        edge = F.greatest(F.abs(b * step - 90 - step), F.abs((b + 1) * step - 90 + step))
        width = F.sin(F.lit(miles / EARTH_RADIUS_MILES / 2)) / F.cos(F.radians(F.least(edge, F.lit(89.999))))
        whole = F.floor(360.0 / F.degrees(2 * F.asin(F.least(F.lit(1.0), width * 1.0001)))).cast("int")
        return F.when(edge >= 89.999, F.lit(1)).otherwise(F.greatest(F.lit(1), whole))  # one cell around a pole

    cell = lambda lon, n: F.pmod(F.floor((lon + 180) / 360.0 * n).cast("int"), n)
    l = left.withColumn("_band", band(F.col("lat")))
    l = l.withColumn("_cell", cell(F.col("lon"), cells(F.col("_band"))))
    r = right.withColumn("_band", F.explode(F.array(*[band(F.col("lat2")) + d for d in (-1, 0, 1)])))
    n = cells(F.col("_band"))
    r = r.withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.pmod(cell(F.col("lon2"), n) + d, n) for d in (-1, 0, 1)]))))
    met = l.join(r, [*on, "_band", "_cell"]).drop("_band", "_cell")
    return met.withColumn("miles", haversine_miles(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("miles") <= miles)


def density_center(members: DataFrame, cluster: str) -> DataFrame:
    """The center of each cluster: most members within the core radius, then least mean distance within the outer one, then place names.

    members: cluster, lat, lon, state, city. Candidates are the distinct places; each place carries its member count.
    """
    spots = members.groupBy(cluster, "state", "city", "lat", "lon").agg(F.count(F.lit(1)).alias("_n"))
    other = spots.select(cluster, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("_n").alias("_m"))
    near = radius_join(spots, other, RADIUS_MILES, [cluster])
    scored = near.groupBy(cluster, "state", "city", "lat", "lon").agg(
        F.sum(F.when(F.col("miles") <= CORE_MILES, F.col("_m")).otherwise(0)).alias("core"), (F.sum(F.col("miles") * F.col("_m")) / F.sum("_m")).alias("mean_miles")
    )
    w = Window.partitionBy(cluster).orderBy(F.desc("core"), F.round("mean_miles", 6), "state", "city", "lat", "lon")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def assignments(actors: DataFrame, hubs: DataFrame, miles: float = RADIUS_MILES) -> DataFrame:
    """actor, hub, miles, overlaps: the nearest hub of an actor's sector within the radius, ties by hub; overlaps counts all in reach.

    actors: actor, sector, lat, lon; hubs: hub, sector, lat2, lon2.
    """
    reach = radius_join(actors, hubs, miles, ["sector"])
    best = reach.groupBy("actor").agg(F.min(F.struct(F.round("miles", 6).alias("miles"), "hub")).alias("b"), F.count(F.lit(1)).alias("overlaps"))
    return best.select("actor", F.col("b.hub").alias("hub"), F.col("b.miles").alias("miles"), "overlaps")


def hub_outcome(same_sector: Column, miles: Column, radius: float = RADIUS_MILES) -> Column:
    """Test of the sector, then of the place."""
    return F.when(~same_sector, "sector_mismatch").when(miles.isNull(), "location_unknown").when(miles <= radius, "eligible").otherwise("outside_radius")


def exclusion(actor: dict[str, Column], sector: Column, statuses: Sequence[str]) -> Column:
    """Why an actor does not count for a new hub of the sector: the first of six rules, or null. actor: status, assigned (array of sectors), merged, category, kind, lat, lon, city, state."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(~F.coalesce(F.lower(actor["status"]).isin(*[s.lower() for s in statuses]), F.lit(False)), "status_not_enabled")
        .when(F.coalesce(F.array_contains(actor["assigned"], sector), F.lit(False)), "already_assigned_same_sector")
        .when(actor["merged"], "merged")
        .when(F.lower(actor["category"]) == "aggregate", "aggregate")
        .when(actor["lat"].isNull() | actor["lon"].isNull() | blank(actor["city"]) | blank(actor["state"]), "missing_deterministic_geography")
        .when(blank(actor["category"]) | blank(actor["kind"]), "missing_classification")
    )


def evaluations(pairs: DataFrame) -> DataFrame:
    """pairs with matched, outcome, priority, miles, outside: the sector is tested before the place, which is not looked at when it fails.

    pairs: sectors (array), lat, lon of an actor; hub_sector, lat2, lon2, radius of a hub.
    """
    matched = F.coalesce(F.array_contains("sectors", F.col("hub_sector")), F.lit(False))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("lat2").isNotNull() & F.col("lon2").isNotNull()
    miles = F.when(F.col("matched") & located, haversine_miles(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    rows = pairs.withColumn("matched", matched).withColumn("miles", miles)
    outside = F.coalesce(F.col("miles") > F.col("radius"), F.lit(False))
    outcome = F.when(~F.col("matched"), "needs_review_sector").when(F.col("miles").isNull() | outside, "needs_review_location").otherwise("assigned")
    return rows.select("*", outcome.alias("outcome"), F.when(F.col("matched"), "normal").otherwise("low").alias("priority"), outside.alias("outside"))


def reassessed(actors: DataFrame, hubs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships: actor, hub, fit, preserved; proposals: actor, sector, hub, miles).

    actors: actor, sectors (array), lat, lon; hubs: hub, hub_sector, lat2, lon2, radius; members: actor, hub, kind. A membership fits, or its sector, radius or place is reported; it is kept either
    way. For every sector of an actor without a hub of that sector, the nearest hub that would be assigned is proposed, ties by hub.
    """
    held = evaluations(members.join(actors, "actor").join(hubs, "hub"))
    fit = F.when(F.col("outcome") == "assigned", "fits").when(~F.col("matched"), "sector_no_longer_matches").when(F.col("outside"), "outside_radius").otherwise("location_unknown")
    memberships = held.select("actor", "hub", fit.alias("fit"), (F.col("kind") == "member").alias("preserved"))
    wanted = actors.withColumn("hub_sector", F.explode("sectors")).join(held.select("actor", "hub_sector").distinct(), ["actor", "hub_sector"], "left_anti")
    near = evaluations(wanted.join(hubs, "hub_sector")).where("outcome = 'assigned'")
    best = near.groupBy("actor", "hub_sector").agg(F.min(F.struct(F.round("miles", 6).alias("miles"), "hub")).alias("b"))
    return memberships, best.select("actor", F.col("hub_sector").alias("sector"), F.col("b.hub").alias("hub"), F.col("b.miles").alias("miles"))


def topic_proposals(hubs: DataFrame, members: DataFrame, centers: DataFrame, by_name: dict[str, str], radius: float = RADIUS_MILES) -> DataFrame:
    """hub, topic, basis, needs_review, members, located, outside: the only primary tag of a hub is its topic; else the name may give one, for review; else none.

    hubs: hub, name, tags (array); members: hub, lat, lon; centers: hub, center_lat, center_lon, as density_center() finds them. outside counts located members beyond the radius of the center.
    """
    far = haversine_miles(F.col("center_lat"), F.col("center_lon"), F.col("lat"), F.col("lon")) > radius
    counted = members.join(centers, "hub", "left").groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.count("lat").alias("located"), F.count_if(far).alias("outside"))
    single = F.size("tags") == 1
    named = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in by_name.items()], F.lit(None).cast("string"))
    topic = F.when(single, F.get("tags", F.lit(0))).otherwise(named)
    basis = F.when(single, "single primary tag").when(named.isNotNull(), "hub name only").otherwise("no deterministic basis")
    return hubs.join(counted, "hub", "left").select("hub", topic.alias("topic"), basis.alias("basis"), (~single).alias("needs_review"), F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("located", F.lit(0)).alias("located"), F.coalesce("outside", F.lit(0)).alias("outside"))


def stated_places(text: Column, states: dict[str, str]) -> Column:
    """array of struct(strength, state, city, headquarters): places that a page ties to an organization, sentence by sentence, strongest first.

    An address ("12 Main St, Austin, TX 78701") is strength 3, "based, located or headquartered in City, ST" 2, another "City, ST" of a line that begins with a contact word 1. States are codes or full names
    from the given table.
    """
    names = "|".join([*states, *states.values()])
    code = lambda w: F.coalesce(*[F.when((w == k) | (F.lower(w) == F.lower(F.lit(v))), F.lit(k)) for k, v in states.items()])
    pair = rf"([A-Z][A-Za-z.]+(?: [A-Z][A-Za-z.]+)?), ({names})\b(?: ([0-9]{{5}}))?"

    def one(s):
        city, state, post = (F.regexp_extract(s, pair, i) for i in (1, 2, 3))
        based = s.rlike(r"(?i)\b(based|located|headquartered|offices?) in\b")
        street = s.rlike(r"\b[0-9]+ [A-Z][a-z]+ (St|Street|Ave|Avenue|Road|Rd|Blvd)\b")
        strength = F.when((post != "") | street, 3).when(based, 2).when(s.rlike(r"(?i)^\s*(contact|address|visit)"), 1).otherwise(0)
        return F.struct((-strength).alias("order"), code(state).alias("state"), city.alias("city"), s.rlike(r"(?i)headquarter|head office").alias("headquarters"))

    found = F.transform(T.sentences(text), one)
    return F.array_sort(F.filter(found, lambda p: p["state"].isNotNull() & (p["order"] < 0)))


def checked_location(claimed: Column, text: Column, states: dict[str, str]) -> Column:
    """struct(action, state, headquarters, operates_in): keep, correct or withhold the state that a reader gave.

    Kept where a statement gives it; corrected where all strongest statements agree on another; withheld where they differ, and kept unconfirmed where the page states no place. headquarters: the state of the
    first statement that says so; operates_in: the other states stated.
    """
    said = stated_places(text, states)
    top = F.array_distinct(F.transform(F.filter(said, lambda p: p["order"] == F.get(said, F.lit(0))["order"]), lambda p: p["state"]))
    every = F.array_distinct(F.transform(said, lambda p: p["state"]))
    head = F.get(F.transform(F.filter(said, lambda p: p["headquarters"]), lambda p: p["state"]), F.lit(0))
    action = F.when(F.size(said) == 0, "unconfirmed").when(F.array_contains(every, claimed), "keep").when(F.size(top) == 1, "correct").otherwise("withhold")
    state = F.when(action.isin("keep", "unconfirmed"), claimed).when(action == "correct", F.get(top, F.lit(0)))
    others = F.filter(every, lambda x: ~x.eqNullSafe(state) & ~x.eqNullSafe(head))
    return F.struct(action.alias("action"), state.alias("state"), head.alias("headquarters"), F.array_sort(others).alias("operates_in"))


def drifted(lat1: Column, lon1: Column, lat2: Column, lon2: Column, frozen: Column, miles: float = DRIFT_MILES) -> Column:
    return frozen & (haversine_miles(lat1, lon1, lat2, lon2) > miles)


def maximum_matching(families: dict[str, list[str]]) -> int:
    """Size of the largest matching of families to categories: rounds of layered search from all free families at once.

    A round layers the families by the shortest alternating paths from free ones (breadth first), then walks disjoint paths of that length with an explicit
    stack; the number of rounds grows with the square root of the families and nothing recurs.
    """
    links = {f: sorted(set(c)) for f, c in families.items()}
    of_family: dict[str, str] = {}
    of_category: dict[str, str] = {}
    while True:
        layer = {f: 0 for f in links if f not in of_family}
        queue, reached = list(layer), False
        for f in queue:  # grows while it is walked
            for c in links[f]:
                holder = of_category.get(c)
                if holder is None:
                    reached = True
                elif holder not in layer:
                    layer[holder] = layer[f] + 1
                    queue.append(holder)
        if not reached:
            return len(of_family)
        open_links = {f: iter(links[f]) for f in links}
        for start in [f for f in links if f not in of_family]:
            path, taken = [start], []
            while path:
                c = next(open_links[path[-1]], None)
                if c is None:
                    path.pop()
                    if taken:
                        taken.pop()
                    continue
                holder = of_category.get(c)
                if holder is None:
                    for f, own in zip(path, [*taken, c]):
                        of_family[f], of_category[own] = own, f
                    break
                if layer.get(holder) == layer[path[-1]] + 1:
                    taken.append(c)
                    path.append(holder)


def fingerprint(families) -> str:
    return hashlib.sha256("\n".join(sorted(set(families))).encode()).hexdigest()


def _miles(lat1, lon1, lat2, lon2) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_MILES * math.asin(math.sqrt(min(1.0, a)))


def detect_clusters(actors: DataFrame, dimension: str, least_families: int = LEAST_FAMILIES, least_categories: int = LEAST_CATEGORIES, core: float = CORE_MILES, radius: float = RADIUS_MILES, hubs: Sequence[tuple] = (), known: Sequence[str] = ()) -> DataFrame:
    """New clusters of each dimension value: value, city, state, families, categories, outcome, fingerprint.

    Centers are ranked by families in the core, then mean distance; a cluster covered by a hub or known by its fingerprint is
    suppressed, one with enough families and matched categories is proposed; either is taken out and the rest ranked again.
    The loop is sequential by meaning, so a dimension value is one task; rows are first summed up to one a family, category and place.

    actors: dimension, family, category, city, state, lat, lon. hubs: (dimension value, lat, lon, radius).
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        value = frame[dimension].iloc[0]
        rows = list(frame.sort_values(["city", "state", "lat", "lon", "family", "category"])[["family", "category", "city", "state", "lat", "lon"]].itertuples(index=False))
        out = []
        while rows:
            spots = sorted({(r.city, r.state, r.lat, r.lon) for r in rows})
            ranked = []
            for city, state, lat, lon in spots:
                near = [(r, d) for r in rows if (d := _miles(lat, lon, r.lat, r.lon)) <= radius]
                inner = len({r.family for r, d in near if d <= core})
                ranked.append((-inner, round(sum(d for _, d in near) / len(near), 6), city, state, lat, lon, [r for r, _ in near]))
            ranked.sort(key=lambda x: x[:6])
            for _, _, city, state, lat, lon, near in ranked:
                fams: dict[str, list[str]] = {}
                for r in near:
                    fams.setdefault(r.family, []).append(r.category)
                print_ = fingerprint(fams)
                if any(h[0] == value and _miles(lat, lon, h[1], h[2]) <= h[3] for h in hubs):
                    outcome = "covered"
                elif len(fams) < least_families or maximum_matching(fams) < least_categories:
                    continue
                else:
                    outcome = "known" if print_ in known or any(o[-1] == print_ for o in out) else "proposed"
                out.append((value, city, state, len(fams), maximum_matching(fams), outcome, print_))
                gone = set(map(id, near))
                rows = [r for r in rows if id(r) not in gone]
                break
            else:
                break
        return pd.DataFrame(out, columns=[dimension, "city", "state", "families", "categories", "outcome", "fingerprint"])

    kind = actors.schema[dimension].dataType.simpleString()
    return actors.select(dimension, "family", "category", "city", "state", "lat", "lon").distinct().groupBy(dimension).applyInPandas(run, f"{dimension} {kind}, city string, state string, families bigint, categories bigint, outcome string, fingerprint string")
