"""Rubrics, bands, gates, rejection ladders and caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as T
from ..functions import urls as U
from .identity import PARTS, QUALIFIERS, STRUCTURAL

#: Weights of the rubrics and the bounds of their bands.
RELEVANCE_WEIGHTS = {
    "own_organisational_page": 0.15,
    "real_operating_entity": 0.15,
    "sector_coverage": 0.15,
    "research_development_or_programmes": 0.25,
    "partnerships_or_tech_transfer": 0.15,
    "identity_stated": 0.15,
}
PRIORITY_WEIGHTS = {
    "use_cases": 0.30,
    "open_programmes": 0.12,
    "named_route_in": 0.12,
    "partnership_precedent": 0.10,
    "partnerships_or_tech_transfer": 0.10,
    "network_membership": 0.06,
    "distinctiveness": 0.15,
    "hub_match": 0.05,
}
COMBINED_WEIGHTS = {
    "own_organisational_page": 0.10,
    "real_operating_entity": 0.11,
    "research_development_or_programmes": 0.08,
    "partnerships_or_tech_transfer": 0.08,
    "open_programmes": 0.07,
    "partnership_precedent": 0.08,
    "named_route_in": 0.08,
    "network_membership": 0.04,
    "use_cases": 0.16,
    "sector_coverage": 0.07,
    "hub_match": 0.03,
    "distinctiveness": 0.10,
}
EVENT_WEIGHTS = {
    "single_discrete_event": 0.15,
    "date_within_window": 0.15,
    "open_external_registration": 0.10,
    "institutional_scale": 0.10,
    "named_speakers": 0.12,
    "named_sponsors_exhibitors_conveners": 0.08,
    "specific_topic": 0.12,
    "hub_geography": 0.05,
    "recurring_prior_editions": 0.05,
    "sector_coverage": 0.08,
}
PERSON_WEIGHTS = {
    "institution_or_self_published": 0.20,
    "research_area_stated": 0.10,
    "sector_intersection": 0.20,
    "hub_or_held_affiliation": 0.15,
    "actionable_role": 0.15,
    "active_work_evidence": 0.15,
    "public_profile_url_present": 0.05,
}
BANDS = {"actor": (0.45, 0.80), "event": (0.30, 0.70), "person": (0.30, 0.70)}
#: Fields that a follow-up can still find; a record that lacks only these is researched, not excluded.
PERSON_FINDABLE = ("identity source", "current affiliation", "role or title", "expertise", "bio or LinkedIn")
EVENT_FATAL = ("official source", "event identity", "relevance")
#: Rubric items that tell of concrete work, and patterns of names and addresses that are no organization's.
SUBSTANCE = ("research_development_or_programmes", "partnerships_or_tech_transfer", "use_cases", "open_programmes")
LIST_NAME = r"(?i)(^|[^a-z])(top [0-9]+|list of|directory|conference|summit|webinar|news|press release|careers|jobs)([^a-z]|$)"
LIST_PATH = r"(?i)/(events?|news|press|blog|careers?|jobs|directory|listings?|tags?|search)(/|$)"
PAGE_WORDS = r"(?i)^(this|the) (page|site|portal|website|overview)|(^|[^a-z])(web ?page|portal|overview) (of|for|about)"


def check_thresholds(low: float, high: float) -> None:
    if not 0 <= low <= high <= 1:
        raise ValueError("bands need 0 <= low <= high <= 1")


def check_weights(weights: dict[str, float], names: Sequence[str]) -> None:
    if set(weights) != set(names) or any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must name every item, be positive and add to one")


def weight_errors(weights: DataFrame, names: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """rubric, errors: what is wrong with each rubric of a weight table (rubric, item, weight), in a fixed order; empty where it may be used."""
    known = F.array_sort(F.array(*map(F.lit, names)))
    grouped = weights.groupBy("rubric").agg(F.array_sort(F.collect_set("item")).alias("items"), F.count(F.lit(1)).alias("n"), F.min("weight").alias("low"), F.sum("weight").alias("total"), F.count_if(F.col("weight").isNull()).alias("blank"))
    lacking, extra = F.array_except(known, "items"), F.array_except("items", known)
    said = F.array_compact(
        F.array(
            F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))),
            F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(extra, ", "))),
            F.when(F.col("n") > F.size("items"), "an item twice"),
            F.when(F.col("blank") > 0, "no number"),
            F.when(F.col("low") < 0, "negative"),
            F.when(F.abs(F.col("total") - 1) > tolerance, "does not add to one"),
        )
    )
    return grouped.select("rubric", F.array_join(said, "; ").alias("errors"))


def rubric(items: Column, weights: dict[str, float]) -> Column:
    """Weighted sum of the true items of a map<string,boolean>; missing items are false."""
    return numbers.weighted_sum({k: F.coalesce(items[k], F.lit(False)).cast("double") for k in weights}, weights)


def band(score: Column, low: float, high: float) -> Column:
    check_thresholds(low, high)
    return F.when(score < low, "auto_low").when(score >= high, "auto_high").otherwise("review")


def capped_band(rubric_band: Column, decision: Column, missing: Column) -> Column:
    """The rubric's band, lowered by the gate's decision and never raised."""
    only_bio = (decision == "research") & (missing == F.array(F.lit("bio or profile"))) & rubric_band.isin("auto_high", "review")
    return F.when(only_bio, "review").when(decision.isin("exclude", "research"), "auto_low").when((decision == "review") & (rubric_band == "auto_high"), "review").otherwise(rubric_band)


def missing(fields: dict[str, Column]) -> Column:
    """Names of the fields whose test does not hold, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in fields.items()]))


PERSON_MANDATORY = ("name", "identity source", "current affiliation", "relevance", "role or title", "expertise", "bio or LinkedIn")
PERSON_PRIORITY = ("department or unit", "public profile link", "relevant work", "work location")
EVENT_MANDATORY = ("official source", "event identity", "confirmed date", "place or online format", "relevance")
EVENT_PRIORITY = ("organizer", "registration", "event type", "description", "themes or agenda", "speakers or participating organizations")
ONLINE_FORMATS = ("online", "hybrid", "virtual")


def filled(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def person_gate(kind: Column, named: Column, placed: Column, rubric: dict[str, Column], record: dict[str, Column], facts: dict[str, Column]) -> Column:
    """struct(decision, missing, missing_priority, identity): can this person be identified, placed and told to be relevant?

    kind: source_kind() of the page; named, placed: whether the page states the name and the affiliation; rubric: institution_or_self_published, sector_intersection;
    record: name, affiliation, role, public_profile_url, research_area; facts: linkedin_url, expertise, bio, department, relevant_work, work_location. Nothing missing is
    accepted; what a named and relevant person (not from a social page) lacks and a follow-up can find is researched; else excluded.
    """
    has_name, linked = filled(record["name"]), filled(facts["linkedin_url"])
    official = (kind == "web") & has_name & named & F.coalesce(rubric["institution_or_self_published"], F.lit(False))
    identity = F.when(official, "official_profile").when(linked, "linkedin")
    relevant = F.coalesce(rubric["sector_intersection"], F.lit(False))
    tests = [has_name, identity.isNotNull(), filled(record["affiliation"]) & placed, relevant, filled(record["role"]), filled(record["research_area"]) | filled(facts["expertise"]), filled(facts["bio"]) | linked]
    lacks = missing(dict(zip(PERSON_MANDATORY, tests)))
    less = missing(dict(zip(PERSON_PRIORITY, [filled(facts["department"]), filled(record["public_profile_url"]), filled(facts["relevant_work"]), filled(facts["work_location"])])))
    findable = F.size(F.array_except(lacks, F.array(*map(F.lit, PERSON_FINDABLE)))) == 0
    decision = F.when(F.size(lacks) == 0, "accept").when(has_name & relevant & (kind != "social") & findable, "research").otherwise("exclude")
    return F.struct(decision.alias("decision"), lacks.alias("missing"), less.alias("missing_priority"), identity.alias("identity"))


def event_gate(kind: Column, page_kind: Column, page_text: Column, run_date: Column, rubric: dict[str, Column], record: dict[str, Column], facts: dict[str, Column], least: int = 2) -> Column:
    """struct(decision, missing, missing_priority, freshness): is this a real, relevant, dated and placed event, from its own or its organizer's page?

    rubric: single_discrete_event, specific_topic, sector_coverage; record: title, start_date, end_date (dates), city, country, location, sectors (array), event_type, description, access_type,
    sponsoring_orgs; facts: event_status, format, organizer, registration_url, themes, speakers, participating_organizations. Cancelled events and those without source, identity or relevance are excluded;
    without a date or place they are researched; conflicting dates, a postponement or fewer than `least` priority fields are for review.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    stated = F.lower(F.coalesce(F.trim(facts["event_status"]), F.lit("")))
    status = F.when(stated != "", stated).otherwise(status_words(page_text))
    start, end = record["start_date"], record["end_date"]
    placed = filled(record["city"]) | filled(record["country"]) | filled(record["location"]) | yes(F.lower(facts["format"]).isin(*ONLINE_FORMATS))
    relevant = (F.coalesce(F.size(record["sectors"]), F.lit(0)) > 0) & (yes(rubric["specific_topic"]) | yes(rubric["sector_coverage"]))
    tests = [(kind == "web") & ~yes(page_kind.isin("news", "listing")), filled(record["title"]) & yes(rubric["single_discrete_event"]), start.isNotNull(), placed, relevant]
    lacks = missing(dict(zip(EVENT_MANDATORY, tests)))
    more = [filled(facts["organizer"]) | filled(record["sponsoring_orgs"]), filled(facts["registration_url"]) | filled(record["access_type"]), filled(record["event_type"]), filled(record["description"]), filled(facts["themes"]), filled(facts["speakers"]) | filled(facts["participating_organizations"])]
    less = missing(dict(zip(EVENT_PRIORITY, more)))
    fatal = F.size(F.array_intersect(lacks, F.array(*map(F.lit, EVENT_FATAL)))) > 0
    freshness = F.when(status == "cancelled", "cancelled").when(start.isNull(), "date_unconfirmed").when(start < run_date, "past").otherwise("upcoming")
    decision = (
        F.when((status == "cancelled") | fatal, "exclude")
        .when(F.size(lacks) > 0, "research")
        .when(yes(end < start) | (status == "postponed"), "review")
        .when(len(EVENT_PRIORITY) - F.size(less) >= least, "accept")
        .otherwise("review")
    )
    return F.struct(decision.alias("decision"), lacks.alias("missing"), less.alias("missing_priority"), freshness.alias("freshness"))


def qualified(start: Column, run_date: Column, months: int, sectors: Column, in_window: Column, registration: Column, institutional: Column, minable: Column, judged: Column) -> Column:
    """struct(accepted, class, reason): attendable, minable, both, mined but not stored, or why an event is rejected.

    judged: whether a rubric was read; without it a date after the window rejects at once.
    """
    end = F.add_months(run_date, months)
    day = start.cast("string")
    attendable = in_window & registration & institutional
    failed = F.concat_ws("; ", F.when(~registration, "registration is not open to external organisations"), F.when(~institutional, "scale or topic does not justify institutional attendance"), F.lit("fewer than three named participants and no named speakers"))
    before = F.concat(F.lit("event date "), day, F.lit(" is before run date "), run_date.cast("string"))
    reason = (
        F.when(start.isNull(), "missing start date")
        .when(~judged & (start > end), F.concat(F.lit("event date "), day, F.lit(" is after window end "), end.cast("string")))
        .when(F.coalesce(F.size(sectors), F.lit(0)) <= 0, "event has no sector match")
        .when(start < run_date, F.when(minable, F.concat(F.lit("mined, not stored: "), before)).otherwise(F.concat(before, F.lit("; fewer than three named participants and no named speakers"))))
        .when(attendable | minable, F.concat(F.lit("qualified as "), F.concat_ws(" and ", F.when(attendable, "attendable"), F.when(minable, "minable"))))
        .otherwise(failed)
    )
    mined = reason.startswith("mined, not stored")
    kind = F.when(mined, "mined, not stored").when(reason.startswith("qualified as "), F.regexp_replace(reason, "^qualified as ", ""))
    return F.struct(kind.isNotNull().alias("accepted"), kind.alias("class"), reason.alias("reason"))


def status_words(text: Column) -> Column:
    """cancelled or postponed where a page says so, empty otherwise."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(r"\b(cancell?ed|will not take place)\b"), "cancelled").when(low.rlike(r"\b(postponed|rescheduled|new dates? to be announced)\b"), "postponed").otherwise("")


def ladder(rules: Sequence[tuple[str, Column]], default: str = "") -> Column:
    """The reason of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for reason, holds in rules:
        out = out.when(F.coalesce(holds, F.lit(False)), F.lit(reason))
    return out.otherwise(F.lit(default))


def verdict(rejects: Sequence[tuple[str, Column]], holds: Sequence[tuple[str, Column]]) -> Column:
    """struct(decision, codes): REJECT with all reject codes, else REVIEW with all hold codes, else ACCEPT."""
    codes = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules]))
    bad, unsure = codes(rejects), codes(holds)
    decision = F.when(F.size(bad) > 0, "REJECT").when(F.size(unsure) > 0, "REVIEW").otherwise("ACCEPT")
    return F.struct(decision.alias("decision"), F.when(F.size(bad) > 0, bad).otherwise(unsure).alias("codes"))


def actor_quality(record: dict[str, Column], page_url: Column, score: Column, present: Column, low: float, high: float, scope_sectors: Sequence[str] = (), scope_states: Sequence[str] = (), focus: Column | None = None, currency: tuple[Column, Column] | None = None, identity: Column | None = None, topic: Column | None = None, priority: Column | None = None, least_items: int = 3, least_description: int = 40, least_identity: float = 0.5, least_topic: float = 0.5, least_priority: float = 0.5) -> Column:
    """struct(decision, codes): REJECT with every reject code, else REVIEW with every hold code, else ACCEPT.

    record: name, website, description, state, place, unit_path, location_basis, operates_in (array of states), sectors (array); present: names of the rubric items that are evidenced.
    currency: (code, whether it rejects). Rejected: nothing read, no name, a list, an event or a news page, sectors or states outside the request (a page that shows work inside it holds instead), a record no longer current,
    a score below the lower bound. Held: no site, another's page, thin or no substantive evidence, a description of a page or a weak one, no place, a unit read for its parent, unreliable identity or topic,
    a focus not met, a score below the upper bound, or a low priority.
    """
    text = lambda k: F.trim(F.coalesce(record[k], F.lit("")))
    name, about, states = text("name"), text("description"), list(scope_states)
    items = F.coalesce(present, F.array().cast("array<string>"))
    listing = ((name != "") & name.rlike(LIST_NAME)) | U.path(page_url).rlike(LIST_PATH)
    other_sector = F.lit(False) if not scope_sectors else ~F.coalesce(F.arrays_overlap(record["sectors"], F.array(*map(F.lit, scope_sectors))), F.lit(False))
    outside = F.lit(False) if not states else (text("state") != "") & ~text("state").isin(*states)
    there = F.lit(False) if not states else F.coalesce(F.arrays_overlap(record["operates_in"], F.array(*map(F.lit, states))), F.lit(False))
    code, rejects = currency if currency else (F.lit(None).cast("string"), F.lit(False))
    reject_list = [
        F.when((name == "") & (F.size(items) == 0), "unreadable_page").when(name == "", "no_name"),
        F.when(listing, "not_an_organisation"),
        F.when(other_sector, "outside_requested_sector"),
        F.when(outside & ~there, "outside_requested_region"),
        F.when(code.isNotNull() & rejects, code),
        F.when(score < low, "below_reject_threshold"),
    ]
    page, own = U.registrable(page_url), U.registrable(text("website"))
    sentences = F.size(F.filter(F.split(about, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != ""))
    number = lambda c, bound, label: F.when(c < bound, label) if c is not None else F.lit(None).cast("string")
    low_priority = F.lit(None).cast("string") if priority is None else F.when(priority < least_priority, "below_auto_verify_priority")
    hold_list = [
        F.when(outside & there, "operates_in_area_based_elsewhere"),
        F.when(own == "", "website_unverified").when(page != own, "third_party_page"),
        F.when(F.size(items) < least_items, "thin_evidence"),
        F.when(~F.array_contains(items, "real_operating_entity"), "entity_unconfirmed"),
        F.when(~F.arrays_overlap(items, F.array(*map(F.lit, SUBSTANCE))), "no_substantive_work"),
        F.when(about.rlike(PAGE_WORDS), "describes_a_page"),
        F.when((F.length(about) < least_description) | ~sentences.between(1, 3), "weak_description"),
        F.when(code.isNotNull() & ~rejects, code),
        F.when(text("location_basis") == "unconfirmed", "location_unconfirmed"),
        F.when((text("place") == "") | (about == ""), "incomplete_record"),
        F.when(F.coalesce(record["unit_path"], F.lit(False)), "unit_or_parent_unclear"),
        number(identity, least_identity, "identity_unreliable"),
        number(topic, least_topic, "weak_topic_evidence"),
        F.lit(None).cast("string") if focus is None else F.when(~focus, "focus_unconfirmed"),
        F.when(score < high, "below_accept_threshold").otherwise(low_priority),
    ]
    bad, unsure = F.array_compact(F.array(*reject_list)), F.array_compact(F.array(*hold_list))
    decision = F.when(F.size(bad) > 0, "REJECT").when(F.size(unsure) > 0, "REVIEW").otherwise("ACCEPT")
    return F.struct(decision.alias("decision"), F.when(F.size(bad) > 0, bad).otherwise(unsure).alias("codes"))


def one_of(*words: str) -> str:
    """A pattern of alternatives."""
    return "(" + "|".join(words) + ")"


def past(*verbs: str) -> list[str]:
    """Regular past forms."""
    return [v + ("d" if v.endswith("e") else "ed") for v in verbs]


def end_pattern() -> str:
    """Sentences that say that an organization is no more: it joined another, was bought, goes by another name, or stopped.

    Each rule is what happened and what has to follow it, so that "acquired funding" and "closed a round" are none of it.
    """
    has, been = one_of("has", "have", "had"), one_of("was", "were", "been")
    work = one_of("operation", "operations", "trading", "business", "work", "activities")
    rules = [
        one_of(*past("merge", "consolidate", "amalgamate"), "folded") + " " + one_of("with", "into"),
        been + " " + one_of(*past("acquire", "purchase"), "bought", "taken over") + " by",
        one_of("is", "are") + " now " + one_of("known as", "part of", "an? " + one_of("division", "subsidiary", "unit") + " of"),
        "formerly known as",
        one_of("ceased", has + " " + one_of(*past("cease", "discontinue"), "stopped", "wound down")) + " (all )?" + work,
        has + " " + one_of("closed", "shut") + " " + one_of("its", "their") + " doors",
        "no longer " + one_of("operating", "in operation", "in business", "exists", "active"),
        one_of("was", "were", has + " been") + " (formally )?dissolved",
    ]
    return "(?i)(^|[^a-z])" + one_of(*rules) + "([^a-z]|$)"


DEFUNCT = end_pattern()
#: Words that a sentence about another organization may share with a name: the tables of words without identity, of kinds and of parts.
COMMON_WORDS = tuple(sorted({*T.STOP_WORDS, *T.LEGAL_WORDS, *STRUCTURAL, *QUALIFIERS, *PARTS, "association", "foundation", "council", "network", "agency", "service", "services", "energy", "power", "new", "public", "solutions", "systems"}))


def currency(name: Column, page: Column, stated: Column, landed: Column, own_site: Column, year: int, stale_years: int = 4, common: Sequence[str] = COMMON_WORDS) -> Column:
    """merged_or_renamed, defunct, outdated_source, stale_own_site, or null for an organization that looks current.

    In order: its stated site leads to another domain; a sentence that names it says that it stopped; the newest year of the page, none after `year`, is
    `stale_years` back, on another's page or on its own. A sentence names it by a distinctive word or by its capitals.
    """
    own = F.filter(T.words(T.plain(name)), lambda w: (F.length(w) >= 3) & ~w.isin(*common))
    capitals = F.regexp_replace(F.array_join(F.transform(F.regexp_extract_all(name, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.substring(w, 1, 1)), ""), "[^A-Z]", "")
    names = lambda s: F.arrays_overlap(own, T.words(T.plain(s))) | ((F.length(capitals) >= 3) & F.contains(s, capitals))
    gone = F.exists(F.split(F.coalesce(page, F.lit("")), "[.]"), lambda s: s.rlike(DEFUNCT) & names(s))
    years = F.transform(F.regexp_extract_all(page, F.lit(r"(?<![0-9.])(19[5-9][0-9]|20[0-4][0-9])(?![0-9])(?![.][0-9])"), F.lit(1)), lambda y: y.cast("int"))
    newest = F.array_max(F.filter(years, lambda y: y <= year))
    moved = (U.registrable(stated) != "") & (U.registrable(landed) != "") & (U.registrable(stated) != U.registrable(landed))
    stale = F.when(newest <= year - stale_years, F.when(own_site, "stale_own_site").otherwise("outdated_source"))
    return F.when(F.coalesce(moved, F.lit(False)), "merged_or_renamed").when(gone, "defunct").otherwise(stale)


# quotes about money, over lower case: who speaks, what receiving says, and what giving, passing on, offering and administering say

#: Bodies that "the ..." stands for, and what money comes as.
BODIES = ("agency", "association", "center", "centre", "college", "company", "council", "district", "foundation", "initiative", "institute", "lab", "laboratory", "network", "organisation", "organization", "program", "programme", "project", "school", "team", "university", "utility")
MONEY = ("award", "donation", "funding", "gift", "grant", "investment", "support")
OWN_BODIES = one_of("team", "company", "cent(er|re)", "lab", "project", "program(me)?", "research", "work", "organi[sz]ation")
SPEAKER = one_of("we", "us", "it", "our( " + OWN_BODIES + ")?", "the " + one_of(*BODIES))
_GAINED = one_of(*[stem + one_of(*ends) for stem, ends in (("receiv", ("ed", "es", "ing")), ("secur", ("ed", "es", "ing")), ("rais", ("ed", "es", "ing")), ("land", ("ed", "s", "ing")))], "recipient of", "won", "wins", "winning", "earned", "obtained")
_CHOSEN = one_of(*past("award"), "granted", "funded", "selected", "chosen")
#: Gains, being chosen, being chosen for something, and closing a round of investment.
GOT = one_of(_GAINED, one_of("is", "are", "was", "were", "been", "being") + " ([a-z]+ )?" + _CHOSEN, one_of("selected", "chosen", "awarded", "granted") + " " + one_of("for", "to receive", "an?", "[$]"), "closed " + one_of("an?", "its", "our") + "[^.]{0,40} round")
#: Up to 60 characters of a sentence may stand between who received and that they did; or the quote begins with it.
WE_GOT = f"(^|[^a-z]){SPEAKER}[^a-z][^.]{{0,60}}{GOT}([^a-z]|$)"
OPENS = f"^[^a-z]*{GOT}"
#: Where the money came from, whoever speaks.
SOURCE = "(^|[^a-z])" + one_of(
    one_of("funded", "supported", "sponsored", "financed", "backed", "underwritten", "made possible") + "( in part)?( [a-z]+)? (by|through)",
    "with ([a-z]+ ){0,2}" + one_of("funding", "support", "grants?", "an award", "investment") + " (from|by)",
    "thanks to (an?|the) [^.]{0,60}" + one_of("grant", "award", "gift", "investment"),
) + "([^a-z]|$)"
#: Whom money goes on to, what it pays for when it is passed on, verbs of giving and acting on a receiver, and phrases of offers and of running a programme for another.
TAKERS = ("applicants", "awardees", "communities", "grantees", "members", "municipalities", "non-?profits", "organi[sz]ations", "projects", "recipients", "researchers", "scholars", "schools", "small businesses", "startups", "students", "utilities")
PAID_FOR = ("communities", "grants", "organi[sz]ations", "projects", "researchers", "scholarships", "startups", "students", "studies")
GIVING = ("administer", "award", "disburse", "distribute", "fund", "give", "gave", "grant", "invest", "manage", "offer", "provide", "make (grants|awards|investments)")
ACTING = ("allocated", "awarded", "chose", "committed", "contributed", "donated", "gave", "granted", "invested", "provided", "selected", "selects")
OFFERING = ("accepting applications", "application deadline", "applications? (are|is|now|open|due|close)", "apply", "eligib(ility|le (applicants|entities|organi[sz]ations))", "(funding|grant) opportunit(y|ies)", "(is|are) open to", "(request|call) for (proposals|applications)", "rfps?")
RUNNING = ("administer(s|ed)?", "manages? the", "on behalf of", "program(me)? administrator")


def word(pattern: str) -> str:
    """The pattern between letters of no word."""
    return f"(^|[^a-z]){pattern}([^a-z]|$)"


_MANY = one_of("[0-9]+", "several", "many", one_of("dozens", "hundreds") + " of")
GIVES = word(one_of("we", "our ([a-z]+ ){0,2}" + one_of("program(me)?s?", "fund", "foundation", "committee"), "the committee") + " (also |annually |now |will |plans? to )?" + one_of(*[g.replace("make ", "makes? ") if " " in g else g + "(e?d|s)?" for g in GIVING]))
PASSES = word(one_of("fund", "support", "award") + "(ed|s|ing)? (more than |over )?" + _MANY + " ([a-z]+ )?" + one_of(*PAID_FOR))
TO_OTHERS = word(one_of("to", "for") + " ([0-9]+ |local |eligible |qualifying |selected |our |its )?" + one_of(*TAKERS))
OFFERS, ADMINISTERS = word(one_of(*OFFERING)), word(one_of(*RUNNING))
#: What a funder does to a name or to "us", and what is addressed to a name: (before the name, after it).
TO_NAME = (one_of(*ACTING) + "[^.]{0,80} ", "")
FOR_NAME = (f"{one_of(*MONEY)}s? (to|for) (the )?", "")
TO_US = f"{TO_NAME[0]}(us([^a-z]|$)|our {OWN_BODIES})"
TRADES_AS = "(d/b/a|dba|doing business as|trading as|operating as) "


def name_pattern(name: Column) -> Column:
    """A pattern of a name in lower case, any signs between its words; one that matches nothing for a name without letters or digits."""
    words = F.array_join(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != ""), "[^a-z0-9]+")
    return F.when(words == "", "[^\\s\\S]").otherwise(words)


def receipt(quote: Column, name: Column, own_site: Column) -> Column:
    """Why a quote does not show that an organization received money, or null where it does: another company trades under its name; it gives, passes on, offers or administers money, or only names it.

    Received it has if a speaker or its name stands before a gain, if the quote says where the money came from or addresses it to the name, or if a funder acts on the name or on "us". Its own site may
    leave out who received; another's page must name the organization.
    """
    low, who = F.lower(F.coalesce(quote, F.lit(""))), name_pattern(name)
    around = lambda before, after: F.regexp_like(low, F.concat(F.lit(f"(^|[^a-z0-9]){before}"), who, F.lit(f"{after}([^a-z0-9]|$)")))
    named = F.regexp_like(low, F.concat(F.lit("(^|[^a-z0-9])"), who, F.lit(f"[^a-z0-9][^.]{{0,60}}{GOT}([^a-z]|$)")))
    received = low.rlike(WE_GOT) | named | low.rlike(SOURCE) | around(*FOR_NAME) | around(*TO_NAME) | low.rlike(TO_US) | (own_site & low.rlike(OPENS))
    says = around("", "")
    return (
        F.when(around(TRADES_AS, ""), "went to a company that trades under the name")
        .when(low.rlike(GIVES) | low.rlike(PASSES) | (low.rlike(TO_OTHERS) & ~received), "gives it to others")
        .when(low.rlike(OFFERS) & ~received, "advertises an opportunity")
        .when(low.rlike(ADMINISTERS) & ~received, "runs a programme for a funder")
        .when(received & (own_site | says), None)
        .when(~own_site, "another's page does not say who received it")
        .otherwise("names the money only")
    )


def valid_rankings(rows: DataFrame, publishers: Sequence[str], available: DataFrame) -> DataFrame:
    """Distinct entity, system, rank, year, scope, subject, url of the entries that are whole and whose page was read.

    A known publisher; a rank that is a number, a range or an open end, with or without a tie mark; a year from 1900 to 2100; a scope of overall or, with a subject, subject.
    """
    rank, subject = F.trim("rank"), F.trim(F.coalesce("subject", F.lit("")))
    whole = F.col("system").isin(*publishers) & rank.rlike(r"^=?[0-9]{1,4}([-–][0-9]{1,4}|\+)?$") & F.col("year").between(1900, 2100) & F.col("scope").isin("overall", "subject") & ((F.col("scope") == "overall") | (subject != ""))
    kept = rows.where(whole).join(available.select("url").distinct(), "url", "left_semi")
    return kept.select("entity", "system", rank.alias("rank"), "year", "scope", F.when(F.col("scope") == "subject", subject).otherwise("").alias("subject"), "url").distinct()


def score_sheet(raw: Column, tier: Column) -> Column:
    """struct(scored, total, tier) of a row's six raw scores: whole scores of 1 to 3 count, the total (of 18) stands where all six do, "Tier n" gives tier_n."""
    scores = F.transform(raw, lambda v: whole_score(v))
    kept = F.array_compact(scores)
    total = F.when(F.size(kept) == F.size(raw), F.aggregate(kept, F.lit(0), lambda a, b: a + b))
    level = F.regexp_extract(F.lower(tier), r"tier\s*([0-9])", 1)
    return F.struct(F.size(kept).cast("bigint").alias("scored"), total.alias("total"), F.when(level != "", F.concat(F.lit("tier_"), level)).alias("tier"))


def whole_score(value: Column, low: int = 1, high: int = 3) -> Column:
    """The whole part of a number in text, if it lies between the bounds."""
    n = F.trim(value).try_cast("double").try_cast("int")
    return F.when(n.between(low, high), n)


def source_kind(host: Column, path: Column, social: Sequence[str], directories: Sequence[str], listings: Sequence[str], news: Sequence[str]) -> Column:
    """social, directory, listing, news or web, in that order; the lists are parameters of bounded size."""
    on = lambda names: F.lit(False) if not names else host.rlike("(^|\\.)(" + "|".join(n.replace(".", "\\.") for n in names) + ")$")
    news_path = F.lower(path).rlike("/(news|press|newsroom|press-releases?|blog|stories)/")
    return F.when(host == "", "unknown").when(on(social), "social").when(on(directories), "directory").when(on(listings), "listing").when(on(news) | news_path, "news").otherwise("web")


def document_address(url_path: Column) -> Column:
    """The address of a file or a document store, not of a page."""
    p = F.lower(url_path)
    return p.rlike(r"\.(pdf|docx?|pptx?|xlsx?)$") | p.rlike("/(documents|uploads)/|/download")


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int, state: str, label: str = "capped") -> DataFrame:
    """df with the state of all rows beyond the first `cap` of each key replaced by the label; no row goes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).withColumn(state, F.when(F.col("_rank") > cap, label).otherwise(F.col(state))).drop("_rank")


def fetch_plan(df: DataFrame, run: Sequence[str], domain: str, order: Sequence[str], most_pages: int, most_domains: int) -> DataFrame:
    """df with `planned`: rows in order until the caps of pages and of domains first seen are met; rows of an admitted domain may go on."""
    place = Window.partitionBy(*run).orderBy(*order)
    first = df.withColumn("_at", F.row_number().over(place)).withColumn("_first", F.min("_at").over(Window.partitionBy(*run, domain)))
    ranked = first.withColumn("_domain", F.dense_rank().over(Window.partitionBy(*run).orderBy("_first")))
    admitted = F.col("_domain") <= most_domains
    page = F.sum(F.when(admitted, 1).otherwise(0)).over(Window.partitionBy(*run).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("planned", admitted & (page <= most_pages)).drop("_at", "_first", "_domain")
