"""Plans of scalar functions: text, addresses, dates, numbers, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import places as P
from .registry import plan

# a name with accents, brackets, legal words and numbers, the same in both languages
NAME_SQL = "(p_name || CASE p_partkey % 4 WHEN 0 THEN ' Café Inc.' WHEN 1 THEN ' (' || p_brand || ') & Co' WHEN 2 THEN ' of the Été LLC' ELSE ' -  Institute ' || p_size END)"
PLAIN = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"


def name():
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, " Café Inc.").when(k == 1, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(") & Co"))).when(k == 2, " of the Été LLC").otherwise(F.concat(F.lit(" -  Institute "), F.col("p_size").cast("string")))
    return F.concat(F.col("p_name"), tail)


def named(t):
    return t.part.select("p_partkey", name().alias("name"), "p_name", "p_brand", "p_type", "p_size")


WORDS = "list_filter(string_split({}, ' '), lambda w: w <> '')"
BARE = "regexp_replace({}, '\\([^)]*\\)', ' ', 'g')"


@plan("st01_clean_text", "SELECT p_partkey, CASE WHEN lower(x) NOT IN ('', 'n/a', 'na', 'none', 'null', 'unknown', '-', 'tbd') THEN x END AS clean FROM (SELECT p_partkey, trim(regexp_replace(CASE WHEN p_partkey % 5 = 0 THEN ' N/A ' ELSE p_name || '  ' || p_brand END, '[ \\t\\n]+', ' ', 'g')) AS x FROM part)")
def _(t):
    v = F.when(F.col("p_partkey") % 5 == 0, " N/A ").otherwise(F.concat_ws("  ", "p_name", "p_brand"))
    return t.part.select("p_partkey", T.clean_text(v).alias("clean"))


@plan("st02_slugify", f"SELECT p_partkey, trim(regexp_replace(strip_accents(lower({NAME_SQL})), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def _(t):
    return named(t).select("p_partkey", T.slugify(F.col("name")).alias("slug"))


@plan("st03_normalize_name", f"SELECT p_partkey, {PLAIN.format(BARE.format(NAME_SQL))} AS name FROM part")
def _(t):
    return named(t).select("p_partkey", T.normalize_name(F.col("name")).alias("name"))


@plan("st04_norm_ampersand", f"SELECT p_partkey, trim(regexp_replace(strip_accents(lower({NAME_SQL})), '[^a-z0-9&]+', ' ', 'g')) AS name FROM part")
def _(t):
    return named(t).select("p_partkey", T.norm_with_ampersand(F.col("name")).alias("name"))


@plan("st05_core_name", f"SELECT p_partkey, array_to_string(list_filter({WORDS.format(PLAIN.format(NAME_SQL))}, lambda w: w NOT IN ('inc', 'llc', 'ltd', 'corp', 'corporation', 'co', 'company', 'the', 'of', 'and')), ' ') AS core FROM part")
def _(t):
    return named(t).select("p_partkey", T.core_name(F.col("name")).alias("core"))


@plan("st06_plain", f"SELECT p_partkey, {PLAIN.format(NAME_SQL)} AS plain FROM part")
def _(t):
    return named(t).select("p_partkey", T.plain(F.col("name")).alias("plain"))


STOP_SQL = "('the', 'of', 'and', 'for', 'in', 'at', 'a', 'an', 'de', 'la')"


@plan("st07_acronym", f"SELECT p_partkey, CASE WHEN len(ws) >= 2 THEN array_to_string(list_transform(ws, lambda w: w[1:1]), '') ELSE '' END AS short FROM (SELECT p_partkey, list_filter({WORDS.format(PLAIN.format(BARE.format(NAME_SQL)))}, lambda w: w NOT IN {STOP_SQL}) AS ws FROM part)")
def _(t):
    return named(t).select("p_partkey", T.acronym(F.col("name")).alias("short"))


@plan("st08_acronym_pair", "SELECT p_partkey, regexp_matches(s, '^[A-Z]{2,8}$') AND lower(s) = left(p_name, 1) || split_part(p_name, ' ', 2)[1:1] AS pair FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN upper(left(p_name, 1) || split_part(p_name, ' ', 2)[1:1]) ELSE 'XQ' END AS s FROM part)")
def _(t):
    own = F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 1, 1)))
    return t.part.select("p_partkey", T.acronym_pair(F.when(F.col("p_partkey") % 2 == 0, own).otherwise("XQ"), F.col("p_name")).alias("pair"))


@plan("st09_singular", "SELECT DISTINCT w, CASE WHEN length(w) <= 3 OR w LIKE '%ses' THEN w WHEN w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN w LIKE '%es' THEN regexp_replace(w, 'es$', '') WHEN w LIKE '%s' THEN regexp_replace(w, 's$', '') ELSE w END AS stem FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations)")
def _(t):
    return t.conversations.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", T.singular(F.col("w")).alias("stem"))


@plan("st10_stem_mentions", "SELECT p_partkey, list_has_all(list_transform(string_split(p_name || ' bolting', ' '), lambda w: w[1:4]), [split_part(p_name, ' ', 2)[1:4], 'bolt']) AND length(split_part(p_name, ' ', 2)) >= 4 AS mentions FROM part WHERE length(split_part(p_name, ' ', 2)) >= 4")
def _(t):
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    return t.part.where(F.length(second) >= 4).select("p_partkey", T.mentions(F.concat(F.col("p_name"), F.lit(" bolting")), F.concat(second, F.lit(" bolts"))).alias("mentions"))


@plan("st11_series_key", f"SELECT p_partkey, {PLAIN.format('p_name')} AS key FROM part")
def _(t):
    title = F.concat(F.lit("12th Annual "), F.col("p_name"), F.lit(" 2024 edition"))
    return t.part.select("p_partkey", T.series_key(title).alias("key"))


@plan("st12_event_words", f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4 AND w NOT IN {STOP_SQL}))), ',') AS ws FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(F.array_sort(T.distinctive_words(F.concat(F.col("p_name"), F.lit(" 2023")))), ",").alias("ws"))


@plan("st13_indel_ratio")
def _(t):
    return t.supplier.select("s_suppkey", T.ratio(F.col("s_name"), F.lit("Supplier 12")).alias("ratio"))


@plan("st14_token_ratios")
def _(t):
    pairs = t.part.select("p_name", "p_type").distinct()
    return pairs.select("p_name", "p_type", T.token_sort_ratio(F.col("p_name"), F.lower("p_type")).alias("sorted"), T.token_set_ratio(F.col("p_name"), F.lower("p_type")).alias("set"))


@plan("st15_sequence_ratio")
def _(t):
    return t.part.select("p_name").distinct().select("p_name", T.sequence_ratio(F.col("p_name"), F.lit("red widget")).alias("ratio"))


@plan("st16_sentences", "SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS INTEGER) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@plan("st17_quote_on_page", f"SELECT conv_id, turn, {PLAIN.format('substr(text, 11, 60)')} <> '' AS found FROM conversations WHERE length(text) > 80")
def _(t):
    return t.conversations.where("length(text) > 80").select("conv_id", "turn", T.quote_on_page(F.substring("text", 11, 60), F.col("text")).alias("found"))


@plan("st18_name_on_page", "SELECT p_partkey, list_has_all(string_split(p_name || ' ' || lower(p_type), ' '), string_split(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' zz' END, ' ')) AS found FROM part")
def _(t):
    who = F.concat(F.lit("Dr. "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" zz"))))
    return t.part.select("p_partkey", T.name_on_page(who, F.concat_ws(" ", "p_name", "p_type")).alias("found"))


LINKS = """CASE WHEN p_size % 7 = 0 THEN 'no link ' || p_name ELSE '<a href="https://www.linkedin.com/in/' || replace(p_name, ' ', '-') || '">x</a>' END || CASE p_size % 4 WHEN 0 THEN ' linkedin.com/in/' || upper(replace(p_name, ' ', '-')) || '?a=1' WHEN 1 THEN ' and linkedin.com/in/' || lower(p_type) || '_' || p_size ELSE ' linkedin.com/company/' || p_type END"""


@plan("st19_only_slug", rf"SELECT p_partkey, CASE WHEN len(s) = 1 THEN s[1] END AS slug FROM (SELECT p_partkey, list_distinct(list_transform(regexp_extract_all({LINKS}, 'linkedin\.com/in/([A-Za-z0-9_-]+)', 1), lambda x: lower(x))) AS s FROM part)")
def _(t):
    return t.part.select("p_partkey", T.only_profile_slug(F.expr(LINKS)).alias("slug"))


def _(t):
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    link = F.concat(F.lit('<a href="https://www.linkedin.com/in/'), slug, F.lit('">x</a>'))
    html = F.when(F.col("p_partkey") % 3 == 0, F.concat(link, link)).otherwise(F.concat(link, F.lit(" linkedin.com/in/other ")))
    return t.part.select("p_partkey", T.only_profile_slug(html).alias("slug"))


TITLED = "CASE p_size % 7 WHEN 0 THEN p_name || ' (' || upper(substr(p_name, 1, 3)) || ')' WHEN 1 THEN upper(substr(p_type, 1, 4)) || ' - ' || p_name WHEN 2 THEN p_name || ' – ' || upper(substr(p_type, 2, 2)) WHEN 3 THEN upper(substr(p_name, 1, 2)) || ': ' || p_name WHEN 4 THEN p_name || ' (' || p_brand || ')' WHEN 5 THEN p_name || ' - ' || p_type || ' (' || substr(p_type, 1, 1) || lower(p_type) || ') ' ELSE ' ' || p_name || '-' || lower(p_type) END"
TITLE_RULES = (r"^(.+?)\s*\(([A-Z][A-Za-z&-]{1,11})\)\s*$", r"^([A-Z]{2,12})\s*[-–:]\s*(.+)$", r"^(.+?)\s*[-–]\s*([A-Z]{2,12})$")


def titled(a: int, b: int, c: int, rest: str) -> str:
    one, two, three = TITLE_RULES
    return f"CASE WHEN regexp_matches(v, '{one}') THEN trim(regexp_extract(v, '{one}', {a})) WHEN regexp_matches(v, '{two}') THEN trim(regexp_extract(v, '{two}', {b})) WHEN regexp_matches(v, '{three}') THEN trim(regexp_extract(v, '{three}', {c})) ELSE {rest} END"


@plan("st20_name_and_acronym", f"SELECT p_partkey, {titled(1, 2, 1, 'trim(v)')} AS name, {titled(2, 1, 2, 'NULL')} AS short FROM (SELECT p_partkey, {TITLED} AS v FROM part)")
def _(t):
    return t.part.select("p_partkey", T.name_and_acronym(F.expr(TITLED)).alias("r")).select("p_partkey", "r.name", "r.short")


def _(t):
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.concat("p_name", F.lit(" (ABC)"))).when(k == 1, F.concat(F.lit("ABC - "), "p_name")).when(k == 2, F.concat("p_name", F.lit(" - ABC"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", T.name_and_acronym(v).alias("r")).select("p_partkey", "r.name", "r.short")


@plan("st21_first_keyword", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'R' WHEN contains(p_name, 'red') THEN 'C' ELSE 'X' END AS code FROM part")
def _(t):
    return t.part.select("p_partkey", T.first_keyword(F.col("p_name"), [("ring", "R"), ("red", "C")], "X").alias("code"))


@plan("st22_institution")
def _(t):
    return t.part.select("p_partkey", T.employing_institution(F.concat(F.lit("Department of "), "p_name", F.lit(", University of "), "p_type")).alias("institution"))


BRACKETED = "p_name || CASE WHEN p_size % 5 = 0 THEN ' (' || p_brand || ') tail' WHEN p_size % 5 = 1 THEN '' ELSE ' (' || p_type || CASE WHEN p_size % 3 = 0 THEN ' ' || substr('of many kinds and sizes', 1, p_size % 20) WHEN p_size % 3 = 1 THEN ' ' || p_brand ELSE '' END || ')' END"


@plan("st23_short_brackets", rf"SELECT p_partkey, CASE WHEN i <> '' AND length(i) <= 15 AND len(list_filter(string_split(trim(i), ' '), lambda w: w <> '')) <= 2 THEN trim(regexp_replace(v, '\s*\([^)]*\)\s*$', '')) ELSE v END AS name FROM (SELECT p_partkey, v, regexp_extract(v, '\(([^)]*)\)\s*$', 1) AS i FROM (SELECT p_partkey, {BRACKETED} AS v FROM part))")
def _(t):
    return t.part.select("p_partkey", T.without_short_brackets(F.expr(BRACKETED)).alias("name"))


def _(t):
    v = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " (ABC)").otherwise(" (one two three)"))
    return t.part.select("p_partkey", T.without_short_brackets(v).alias("name"))


@plan("st24_name_similarity", "SELECT p_partkey, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END AS similarity FROM (SELECT p_partkey, list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4)) AS a, list_distinct(list_filter(string_split(p_name || ' ring', ' '), lambda w: length(w) >= 4 AND w NOT IN ('small'))) AS b FROM part)")
def _(t):
    other = F.trim(F.regexp_replace(F.concat("p_name", F.lit(" ring")), "small", ""))
    return t.part.select("p_partkey", T.name_similarity(F.col("p_name"), other).alias("similarity"))


@plan("st25_variants", "SELECT p_partkey, p_name || ' Inc|' || p_name || '|' || upper(left(p_name, 1) || split_part(p_name, ' ', 2)[1:1] || 'i') AS variants FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(T.name_variants(F.concat("p_name", F.lit(" Inc"))), "|").alias("variants"))


@plan("st26_markers", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(p_name, '(ring|widget|bolt|gear)'))), ',') AS found FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(T.markers(F.col("p_name"), "ring|widget|bolt|gear"), ",").alias("found"))


@plan("st27_truncated", "SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substr(text, 1, 60), '[ \\t\\n\\r\\f\\v]+[^ \\t\\n\\r\\f\\v]*$', '') || '…' END AS short FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", T.truncated(F.col("text"), 60).alias("short"))


@plan("st28_chunks")
def _(t):
    return t.documents.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("position", "chunk"))


# addresses


HOST_SQL = "regexp_replace(lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)), '^www\\.', '')"


@plan("ur01_host", f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def _(t):
    return t.pages.select("page_id", U.host(F.col("url")).alias("host"))


@plan("ur02_registrable", f"SELECT page_id, array_to_string(string_split({HOST_SQL}, '.')[-2:], '.') AS domain, CASE WHEN page_id % 2 = 0 THEN array_to_string(string_split({HOST_SQL}, '.')[-2:-2], '.') || '.co.uk' ELSE 'co.uk' END AS british FROM pages")
def _(t):
    label = F.element_at(F.split(U.host(F.col("url")), r"\."), -2)
    british = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://x.y."), label, F.lit(".co.uk/a"))).otherwise(F.lit("co.uk"))
    return t.pages.select("page_id", U.registrable(F.col("url")).alias("domain"), U.import_domain(british).alias("british"))


@plan("ur03_canonical", "SELECT page_id, rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') AS canonical FROM pages")
def _(t):
    return t.pages.select("page_id", U.canonical(F.col("url")).alias("canonical"))


@plan("ur04_strict_canonical")
def _(t):
    return t.pages.select("page_id", U.strict_canonical(F.col("url")).alias("canonical"))


ADDRESS = "'https://' || CASE WHEN p_size % 2 = 0 THEN 'www.' ELSE '' END || replace(p_name, ' ', '-') || '.Example.org' || CASE WHEN p_size % 6 = 0 THEN '' WHEN p_size % 6 = 1 THEN '/' WHEN p_size % 6 = 2 THEN '/?q=' || p_size WHEN p_size % 6 = 3 THEN '//' ELSE '/' || lower(p_type) || '/' || p_partkey END"


@plan("ur05_homepage", rf"SELECT p_partkey, CASE WHEN regexp_replace(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', '', 'g') <> '' OR contains(u, '?') THEN '' ELSE regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') END AS home FROM (SELECT p_partkey, {ADDRESS} AS u FROM part)")
def _(t):
    return t.part.select("p_partkey", U.homepage(F.expr(ADDRESS)).alias("home"))


def _(t):
    root = F.concat(F.lit("https://"), U.host(F.col("url")), F.lit("/"))
    return t.pages.select("page_id", U.homepage(F.when(F.col("page_id") % 2 == 0, root).otherwise(F.concat(root, F.lit("a/b")))).alias("home"))


PLACED = "'https://x.org/' || CASE p_type WHEN 'SMALL' THEN 'Lab' WHEN 'LARGE' THEN 'about/center' WHEN 'ECONOMY' THEN 'department' WHEN 'MEDIUM' THEN 'programs' WHEN 'PROMO' THEN 'college' ELSE lower(p_type) END || CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '/' || p_partkey WHEN 2 THEN '-' || replace(p_name, ' ', '-') WHEN 3 THEN 'ing/' || p_size ELSE '?lab=/lab/' END"


@plan("ur06_unit_path", f"SELECT p_partkey, regexp_matches(lower(regexp_extract({PLACED}, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/(department|dept|school|college|center|centre|institute|lab|labs|program|programs)(/|-|$)') AS unit FROM part")
def _(t):
    return t.part.select("p_partkey", U.unit_path(F.expr(PLACED)).alias("unit"))


def _(t):
    return t.pages.select("page_id", U.unit_path(F.when(F.col("page_id") % 2 == 0, "https://x.org/lab/9").otherwise("https://x.org/labour")).alias("unit"))


@plan("ur07_key", "SELECT page_id, rtrim(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '/') AS key FROM pages")
def _(t):
    return t.pages.select("page_id", U.key(F.col("url")).alias("key"))


@plan("ur08_typed", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'https://bare.example.org/x' END AS typed FROM pages")
def _(t):
    k = F.col("page_id") % 3
    return t.pages.select("page_id", U.typed(F.when(k == 0, F.col("url")).when(k == 1, "bare.example.org/x").otherwise("not an address")).alias("typed"))


PEOPLE = "'https://x.edu/' || CASE p_type WHEN 'SMALL' THEN 'People' WHEN 'LARGE' THEN 'faculty' WHEN 'ECONOMY' THEN 'news' WHEN 'MEDIUM' THEN 'directory' WHEN 'PROMO' THEN 'team' ELSE lower(p_type) END || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/' || replace(p_name, ' ', '-') ELSE '-' || p_size || '/stories/' || p_partkey END"
PERSON_PATH = "lower(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1))"


@plan("ur09_profile_kind", f"SELECT p_partkey, CASE WHEN regexp_matches({PERSON_PATH}, '/(people|person|profile|profiles|faculty|staff|team)/[^/]+') THEN 'profile' WHEN regexp_matches({PERSON_PATH}, '/(people|faculty|staff|team|directory)/?$') THEN 'list' WHEN regexp_matches({PERSON_PATH}, '/(news|blog|press|stories)/') THEN 'news' ELSE 'other' END AS kind FROM (SELECT p_partkey, {PEOPLE} AS u FROM part)")
def _(t):
    return t.part.select("p_partkey", U.profile_kind(F.expr(PEOPLE)).alias("kind"))


def _(t):
    k = F.col("page_id") % 4
    return t.pages.select("page_id", U.profile_kind(F.when(k == 0, "https://x.edu/people/ann").when(k == 1, "https://x.edu/faculty/").when(k == 2, "https://x.edu/news/a").otherwise("https://x.edu/about")).alias("kind"))


# dates


DAY_SQL = "CAST(o_orderdate AS DATE)"


@plan("dt01_parsed", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE {DAY_SQL} END AS day FROM orders")
def _(t):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM d'th', yyyy")).when(k == 2, F.date_format(d, "M/d/yyyy")).when(k == 3, F.date_format(d, "d MMM yyyy")).otherwise("soon")
    return t.orders.select("o_orderkey", D.parsed(text).alias("day"))


@plan("dt02_partial", f"SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN {DAY_SQL} WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN date_trunc('year', o_orderdate) ELSE make_date(year(o_orderdate), 3, 1) END AS DATE) AS low, CAST(CASE o_orderkey % 4 WHEN 0 THEN {DAY_SQL} WHEN 1 THEN last_day(o_orderdate) WHEN 2 THEN make_date(year(o_orderdate), 12, 31) ELSE make_date(year(o_orderdate), 5, 31) END AS DATE) AS high, o_orderkey % 4 = 0 AS exact FROM orders")
def _(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy")).otherwise(F.concat(F.lit("Spring "), F.date_format(d, "yyyy")))
    return t.orders.select("o_orderkey", D.partial(text).alias("p")).select("o_orderkey", F.col("p.first").alias("low"), F.col("p.last").alias("high"), "p.exact")


@plan("dt03_span", f"SELECT o_orderkey, {DAY_SQL} AS low, CASE WHEN o_orderkey % 3 = 0 THEN {DAY_SQL} ELSE {DAY_SQL} + 2 END AS high FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderkey") % 3 == 0, F.date_sub(d, 4)).otherwise(F.date_add(d, 2))
    return t.orders.select("o_orderkey", D.span(d, end).alias("s")).select("o_orderkey", F.col("s.first").alias("low"), F.col("s.last").alias("high"))


@plan("dt04_status", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'date unconfirmed' WHEN {DAY_SQL} < DATE '1998-01-01' THEN 'past' ELSE 'upcoming' END AS status FROM orders")
def _(t):
    d = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", D.status(d, d, F.lit("1998-01-01").cast("date")).alias("status"))


@plan("dt05_shown", f"SELECT o_orderkey, strftime({DAY_SQL}, '%-d %b %Y') || ' - ' || strftime({DAY_SQL} + 1, '%-d %b %Y') AS shown FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", D.shown(d, F.date_add(d, 1)).alias("shown"))


DATED = "CASE o_orderkey % 6 WHEN 0 THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) - o_orderkey % 4 * 40 AS STRING) WHEN 1 THEN ' ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ' ' WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 10:00' WHEN 3 THEN CAST(month(o_orderdate) + 3 AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) WHEN 4 THEN CAST(day(o_orderdate) AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) ELSE CAST(year(o_orderdate) AS STRING) || '-02-' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') END"


@plan("dt06_us_date", rf"SELECT o_orderkey, CASE WHEN year(d) BETWEEN 1900 AND 2100 THEN d END AS day FROM (SELECT o_orderkey, CASE WHEN regexp_full_match(v, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN CAST(try_strptime(v, '%m/%d/%Y') AS DATE) WHEN regexp_full_match(v, '\d{{4}}-\d{{2}}-\d{{2}}') THEN TRY_CAST(v AS DATE) END AS d FROM (SELECT o_orderkey, trim({DATED}) AS v FROM orders))")
def _(t):
    return t.orders.select("o_orderkey", D.us_date(F.expr(DATED)).alias("day"))


def _(t):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    return t.orders.select("o_orderkey", D.us_date(F.when(k == 0, F.date_format(d, "MM/dd/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm"))).alias("day"))


@plan("dt07_newest_year", "SELECT o_orderkey, CAST(greatest(year(o_orderdate), 2001) AS INTEGER) AS newest FROM orders")
def _(t):
    text = F.concat(F.lit("Since "), F.date_format("o_orderdate", "yyyy"), F.lit(", FY01 report; goals for 2090"))
    return t.orders.select("o_orderkey", D.newest_year(text, 2004).alias("newest"))


@plan("dt08_funding_status", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'undated' WHEN {DAY_SQL} + 30 >= DATE '1998-06-01' THEN 'active' WHEN date_diff('day', {DAY_SQL} + 30, DATE '1998-06-01') <= 365 THEN 'recently_completed' ELSE 'historical' END AS status FROM orders")
def _(t):
    d = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", D.funding_status(d, F.date_add(d, 30), F.lit("1998-06-01").cast("date")).alias("status"))


@plan("dt09_month", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.month(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))).alias("month"))


@plan("dt10_dated_prefix", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {DAY_SQL} END AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'Launch' ELSE 'Launch only' END AS title FROM orders")
def _(t):
    v = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": Launch"))).otherwise("Launch only")
    return t.orders.select("o_orderkey", D.dated_prefix(v).alias("r")).select("o_orderkey", "r.day", "r.title")


@plan("dt11_freshness", f"SELECT o_orderkey, CAST(CASE WHEN n <= 90 THEN 90 WHEN n <= 180 THEN 180 WHEN n <= 365 THEN 365 END AS INTEGER) AS fresh FROM (SELECT o_orderkey, date_diff('day', {DAY_SQL}, DATE '2000-01-01') AS n FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", D.freshness(F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate"))).alias("fresh"))


@plan("dt12_stalled", "SELECT event_id, epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts)) > 3600 AS stalled FROM events")
def _(t):
    return t.events.select("event_id", D.stalled(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp"), 3600).alias("stalled"))


# numbers


LAT, LON = "(25 + (({0} * 37) % 240) / 10.0)", "(-120 + (({0} * 53) % 500) / 10.0)"


def lat(c):
    return 25 + (F.col(c) * 37 % 240) / 10.0


def lon(c):
    return -120 + (F.col(c) * 53 % 500) / 10.0


MILES = "2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


@plan("ma01_haversine", f"SELECT s_suppkey, CAST(floor({MILES.format(LAT.format('s_suppkey'), LON.format('s_suppkey'), LAT.format('s_nationkey'), LON.format('s_nationkey'))} * 1000 + 0.5) AS BIGINT) AS thousandths FROM supplier")
def _(t):
    d = N.haversine_miles(lat("s_suppkey"), lon("s_suppkey"), lat("s_nationkey"), lon("s_nationkey"))
    return t.supplier.select("s_suppkey", F.floor(d * 1000 + 0.5).alias("thousandths"))


@plan("ma02_weighted_sum", "SELECT event_id, CAST(round((k % 2) * 0.25 * 1e6) + round((k % 5) / 5.0 * 0.75 * 1e6) AS BIGINT) AS micros FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    s = N.weighted_sum({"a": (k % 2).cast("double"), "b": (k % 5) / 5.0}, {"a": 0.25, "b": 0.75})
    return t.events.select("event_id", F.round(s * 1e6).cast("bigint").alias("micros"))


@plan("ma03_cosine", "SELECT vec_id, CAST(floor(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) * 1e6 + 0.5) AS BIGINT) AS micros FROM embeddings")
def _(t):
    asked = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(asked), F.lit(True)).select("vec_id", F.floor(N.cosine(F.col("embedding"), F.col("q")) * 1e6 + 0.5).alias("micros"))


@plan("ma04_set_ratios", "SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS jaccard, len(list_intersect(a, b)) / least(len(a), len(b)) AS containment FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, ['red', 'ring', 'gear', 'small'] AS b FROM part)")
def _(t):
    a, b = F.array_distinct(F.split("p_name", " ")), F.array(*map(F.lit, ["red", "ring", "gear", "small"]))
    return t.part.select("p_partkey", T.jaccard(a, b).alias("jaccard"), T.containment(a, b).alias("containment"))


@plan("ma06_distinctiveness", "SELECT n_nationkey, CASE WHEN n IS NULL THEN 0.0 ELSE 1.0 / (1.0 + n) END AS distinct_share FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey".replace("0.0 ELSE 1.0 / (1.0 + n)", "CAST(0 AS DOUBLE) ELSE 1 / (CAST(1 AS DOUBLE) + n)"))
def _(t):
    held = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return t.nation.join(held, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", N.distinctiveness(F.col("n")).alias("distinct_share"))


@plan("ma07_micro_units", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * 10000 / 1e6 AS units FROM orders")
def _(t):
    return t.orders.select("o_orderkey", N.micros_to_units(F.round(F.col("o_totalprice") * 100).cast("bigint") * 10000).alias("units"))


@plan("ma08_bounded_int", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN p_size END AS level FROM part")
def _(t):
    return t.part.select("p_partkey", N.bounded_int(F.concat(F.lit("TRL "), F.col("p_size").cast("string"), F.lit(" (of 9)")), 1, 9).alias("level"))


# arrays and JSON


@plan("js01_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_contains(props, '{\"k\": 3}') AS three FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), (F.variant_get(F.parse_json("props"), "$.k", "bigint") == 3).alias("three"))


LISTED = "CASE event_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[' || props || ', 1, [2, 3]]' WHEN 2 THEN '[' || substr('1,2,3,4,5,6,7,8', 1, CAST(1 + 2 * (user_id % 8) AS INT)) || ']' WHEN 3 THEN '[broken, ' || event_type ELSE props END"


@plan("js02_json_length", f"SELECT event_id, CAST(CASE WHEN json_valid(v) AND json_type(v) = 'ARRAY' THEN json_array_length(v) ELSE 0 END AS INTEGER) AS n FROM (SELECT event_id, {LISTED} AS v FROM events)")
def _(t):
    return t.events.select("event_id", C.json_length(F.expr(LISTED)).alias("n"))


def _(t):
    v = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit(", 1]"))).otherwise(F.col("props"))
    return t.events.select("event_id", C.json_length(v).alias("n"))


@plan("js03_ordered_list", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids, arg_min(event_type, (ts, event_id)) AS first_type FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1")
def _(t):
    rows = t.events.where(F.col("event_type").isin("purchase", "signup")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    return rows.select("user_id", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("ids"), F.col("l")[0]["event_type"].alias("first_type"))


@plan("js04_unnest", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, split_part(p_name, ' ', 1) AS first_word FROM part")
def _(t):
    parts = F.split("p_name", " ")
    return t.part.select("p_partkey", F.explode(parts).alias("word"), F.element_at(parts, 1).alias("first_word"))


MAYBE_JSON = """CASE p_size % 6 WHEN 0 THEN '"' || p_name || '"' WHEN 1 THEN p_name WHEN 2 THEN '{"a": "' || p_name || '"}' WHEN 3 THEN CAST(p_size AS STRING) WHEN 4 THEN '"' || p_name ELSE '"say \\"' || p_type || '\\" ' || p_brand || '"' END"""


@plan("js05_decoded", f"SELECT p_partkey, CASE WHEN json_valid(v) AND json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE v END AS value FROM (SELECT p_partkey, {MAYBE_JSON} AS v FROM part)")
def _(t):
    return t.part.select("p_partkey", C.decoded(F.expr(MAYBE_JSON.replace("\\", "\\\\"))).alias("value"))


def _(t):
    v = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", C.decoded(v).alias("value"))


@plan("js06_canonical_digest", "SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\"}') AS digest FROM part")
def _(t):
    return t.part.select("p_partkey", C.canonical_digest({"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("digest"))


@plan("js07_set_fingerprint", "SELECT user_id, sha256(string_agg(DISTINCT event_type, chr(10) ORDER BY event_type)) AS fingerprint FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("s")).select("user_id", C.set_fingerprint(F.col("s")).alias("fingerprint"))


@plan("js08_cleaned_list", "SELECT p_partkey, split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) AS items FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def _(t):
    own = F.split("p_name", " ")
    items = F.concat(own, F.array(F.lit(" ")), F.transform(own, lambda x: F.upper(x)))
    return t.part.where(own[0] != own[1]).select("p_partkey", F.array_join(C.cleaned_list(items), "|").alias("items"))


@plan("js09_code_list", "SELECT p_partkey, upper(p_brand) || ',' || upper(p_type) AS codes FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(C.code_list(F.concat_ws(" ; ", "p_brand", "p_type", F.lower("p_brand"))), ",").alias("codes"))


# places


STATE_SQL = "['ny', 'TX', 'ca ', 'ZZ', 'DC'][s_suppkey % 5 + 1]"


def state():
    return F.element_at(F.array(*map(F.lit, ["ny", "TX", "ca ", "ZZ", "DC"])), (F.col("s_suppkey") % 5 + 1).cast("int"))


@plan("ge01_region_of_state", f"SELECT s_suppkey, CASE upper(trim({STATE_SQL})) WHEN 'NY' THEN 'northeast' WHEN 'TX' THEN 'south_central_texas_gulf' WHEN 'CA' THEN 'west_coast_pacific' WHEN 'DC' THEN 'mid_atlantic' END AS region FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", P.region_of(state()).alias("region"))


TOWN = "CASE WHEN s_suppkey % 5 = 0 THEN 'St. ' WHEN s_suppkey % 5 = 1 THEN 'Ft ' WHEN s_suppkey % 5 = 2 THEN 'Mt. ' ELSE '' END || s_name || CASE s_nationkey % 6 WHEN 0 THEN ' city' WHEN 1 THEN ' Town Village' WHEN 2 THEN ' (Québec)' WHEN 3 THEN ' City of' WHEN 4 THEN ' township CITY town' ELSE '' END"
CITY_RULE = f"regexp_replace(array_to_string(list_transform(list_filter(string_split({PLAIN.format('v')}, ' '), lambda w: w <> ''), lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.CITY_ALIASES.items()) + f" ELSE w END), ' '), '( ({'|'.join(P.CITY_SUFFIXES)}))+$', '')"


@plan("ge02_city", f"SELECT s_suppkey, {CITY_RULE} AS city FROM (SELECT s_suppkey, {TOWN} AS v FROM supplier)")
def _(t):
    return t.supplier.select("s_suppkey", P.normalized_city(F.expr(TOWN)).alias("city"))


def _(t):
    raw = F.when(F.col("s_suppkey") % 3 == 0, "St. Paul city").when(F.col("s_suppkey") % 3 == 1, "Ft Worth town village").otherwise("Québec")
    return t.supplier.select("s_suppkey", P.normalized_city(raw).alias("city"))


@plan(
    "ge03_gazetteer",
    f"""WITH places AS (SELECT 'town ' || (n_nationkey % 9) AS city, ['NY', 'TX', 'CA'][n_nationkey % 3 + 1] AS state, {LAT.format('n_nationkey')} AS lat FROM nation),
    g AS (SELECT city, state, count(*) AS n, min(lat) AS lat FROM places GROUP BY 1, 2),
    r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'town ' || (s_suppkey % 12) END AS city, upper(trim({STATE_SQL})) AS state FROM supplier)
    SELECT s_suppkey, CASE WHEN r.city = '' THEN 'missing' WHEN r.state NOT IN ('NY', 'TX', 'CA') THEN 'unknown state' WHEN n IS NULL THEN 'not found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS reason, CASE WHEN r.city <> '' AND n = 1 THEN CAST(round(g.lat * 10) AS BIGINT) END AS tenths FROM r LEFT JOIN g ON g.city = r.city AND g.state = r.state""",
)
def _(t):
    n = F.col("n_nationkey")
    gazetteer = t.nation.select(F.concat(F.lit("town "), (n % 9).cast("string")).alias("city_key"), F.element_at(F.array(*map(F.lit, ["NY", "TX", "CA"])), (n % 3 + 1).cast("int")).alias("state"), lat("n_nationkey").alias("lat"), lon("n_nationkey").alias("lon"))
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 11 == 0, "").otherwise(F.concat(F.lit("Town "), (F.col("s_suppkey") % 12).cast("string"))).alias("city"), state().alias("st"))
    return P.gazetteer_lookup(rows, gazetteer, "city", "st").select("s_suppkey", "reason", F.round(F.col("lat") * 10).cast("bigint").alias("tenths"))


LAND = "CASE s_suppkey % 6 WHEN 0 THEN 'U.S.A.' WHEN 1 THEN ' United   STATES' WHEN 2 THEN n_name || ' ' WHEN 3 THEN lower(n_name) || '!' WHEN 4 THEN '  ' ELSE n_name END"
LANDS = {"u s a": "United States", "usa": "United States", "united states": "United States", "nation 3": "Third Nation", "nation 7": "Seventh Nation"}


@plan("ge07_country", f"SELECT s_suppkey, CASE {PLAIN.format('v')} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANDS.items()) + f" ELSE nullif(trim(v), '') END AS country FROM (SELECT s_suppkey, {LAND} AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def _(t):
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", P.country(F.expr(LAND), LANDS).alias("country"))


def _(t):
    raw = F.when(F.col("s_suppkey") % 3 == 0, "U.S.A.").when(F.col("s_suppkey") % 3 == 1, " Morocco ").otherwise("  ")
    return t.supplier.select("s_suppkey", P.country(raw, {"u s a": "United States", "usa": "United States"}).alias("country"))
