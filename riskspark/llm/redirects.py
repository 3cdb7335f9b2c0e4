"""URL verdicts by redirect equivalence.

Rules decide addresses by host suffix and path prefix. Redirects (a refresh in the page's head, or a given
table of redirects) and canonical links join addresses to components; an address without a rule takes its
component's decision, where one explicit allow outweighs any block. All steps are DataFrame operations.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.components import connected_components
from riskspark.session import materialise


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """Host, path (an empty one is the root) and query: urls that differ in scheme or fragment are one address."""
    own = path(url)
    return F.when(F.instr(url, "://") > 0, F.concat(
        host(url), F.when(own == "", "/").otherwise(own), F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)))


def fits(rule: Rule, host_: Column, path_: Column) -> Column:
    return ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)


def decide(rules: tuple[Rule, ...], host_: Column, path_: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; among equals an allow, then the first by text."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))
    none = F.lit(None).cast("string")
    text = reduce(lambda rest, r: F.when(fits(r, host_, path_), r.text).otherwise(rest), reversed(order), none)
    verdict = reduce(lambda rest, r: F.when(fits(r, host_, path_), r.verdict).otherwise(rest), reversed(order), none)
    return text, verdict


#: The named characters that addresses in attributes are written with.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescaped(text: Column) -> Column:
    """Character references of an attribute as characters: the five named ones and any number. Others stay as they are."""
    def character(part: Column) -> Column:
        number = F.regexp_extract(part, "^#([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});", 1)
        code = F.when(F.lower(number).startswith("x"), F.substring(number, 2, 6)).otherwise(F.conv(number, 10, 16))
        rest = F.regexp_replace(part, "^#[0-9A-Za-z]+;", "")
        value = F.conv(code, 16, 10).cast("long")
        # Numbers that are no character stay as they are written.
        sound = ((value > 0) & (value < 0xD800)) | ((value > 0xDFFF) & (value < 0x110000))
        known = F.when((number != "") & sound, F.concat(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), rest))
        for name, sign in NAMED.items():
            known = known.when(part.startswith(f"{name};"), F.concat(F.lit(sign), F.substring(part, len(name) + 2, 1 << 30)))
        return known.otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&", -1)
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), character), ""))


def _walked(folders: Column) -> Column:
    """A path without its steps: ``.`` goes, ``..`` takes the folder before along; a last step leaves a folder."""
    steps = F.split(folders, "/", -1)
    last = F.element_at(steps, -1)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda own, step: (
        F.when(step == "..", F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))).when(step == ".", own).otherwise(F.concat(own, F.array(step)))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolve(base: Column, link: Column) -> Column:
    """A link as an absolute url, seen from the page ``base``, by the rules for references.

    A query alone keeps the page's path, a fragment alone the page's path and query; folders are walked.
    """
    own, rest = path(base), F.regexp_extract(link, r"[?#].*$", 0)
    way = F.regexp_extract(link, "^[^?#]*", 0)
    folder = F.regexp_extract(own, "^(.*/)?", 0)
    query = F.regexp_extract(after_scheme(base), r"^[^?#]*(\?[^#]*)?", 1)
    from_root = F.when(way.startswith("/"), way).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), way))
    there = F.when(way == "", F.concat(own, F.when(rest.startswith("?"), rest).otherwise(F.concat(query, rest)))).otherwise(
        # The first step is the empty one before the leading slash.
        F.concat(F.lit("/"), _walked(F.substring(from_root, 2, 1 << 30)), rest))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(~link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(F.lit("http://"), host(base), there)))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value: quoted either way, or bare."""
    ways = ('"([^"]*)"', "'([^']*)'", r"([^\"'\s>]+)")
    found = [F.regexp_extract(tag, rf"(?i)[\s\"'/]{name}\s*=\s*{way}", 1) for way in ways]
    return F.trim(F.coalesce(*(F.when(f != "", f) for f in found), F.lit("")))


def page_links(pages: DataFrame) -> DataFrame:
    """``source``, ``target`` urls of canonical links and refreshes in ``pages`` (columns ``url``, ``html``).

    Attributes may be quoted either way or bare, in any order; references in them are decoded. A refresh's url may be quoted
    within the attribute. Links of other schemes (``mailto:``) lead nowhere.
    """
    tags = F.regexp_extract_all("html", F.lit("(?i)<(?:link|meta)\\b[^>]*>"), F.lit(0))
    marked = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag"))
    tag, link_tag, meta_tag = F.col("tag"), F.col("tag").rlike("(?i)^<link"), F.col("tag").rlike("(?i)^<meta")
    relations = F.split(F.lower(_attribute(tag, "rel")), r"\s+")
    canonical = F.when(link_tag & F.array_contains(relations, "canonical"), _attribute(tag, "href"))
    wanted = F.regexp_extract(_attribute(tag, "content"), r"(?i)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(.*)$", 1)
    bare = F.regexp_replace(unescaped(wanted), "^([\"'])([^\"']*)\\1.*$", "$2")
    refresh = F.when(meta_tag & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), F.trim(bare))
    found = marked.select("url", F.explode(F.array(unescaped(canonical), refresh)).alias("link")).where("link <> ''")
    return found.select(F.col("url").alias("source"), resolve(F.col("url"), F.col("link")).alias("target")).where("target IS NOT NULL")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    A null url, or one without ``://``, has an empty host and path and is no alias of anything. Null html has no links.
    ``redirects`` may add rows of ``source`` and ``target`` urls. Repeated pages are judged alike; other columns are
    ignored; no rows give no rows. A page without a rule whose component has no rule either is allowed.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    edges = materialise(links.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    components = materialise(connected_components(edges), "components")
    whole = F.concat(F.lit("http://"), F.col("node"))
    _, own = decide(rules, host(whole), path(whole))
    decided = components.withColumn("own", own).groupBy("component").agg(
        F.when(F.max(F.col("own") == "allow"), "allow").when(F.max(F.col("own") == "block"), "block").alias("spread"))
    inherited = components.join(decided, "component").where("spread IS NOT NULL").select("node", "spread")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), address(url).alias("node"))
    rule, verdict = decide(rules, F.col("host"), F.col("path"))
    return rows.join(inherited, "node", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("spread"), F.lit("allow")).alias("verdict"))


def _sql_attribute(name: str) -> str:
    start = rf"(?i)[\s\"''/]{name}\s*=\s*"
    ways = (rf"""{start}"([^"]*)\"""", rf"{start}''([^'']*)''", rf"{start}([^\"''\s>]+)")
    return f"trim(coalesce({', '.join(f"nullif(regexp_extract(tag, '{way}', 1), '')" for way in ways)}, ''))"


def _sql_decoded(value: str) -> str:
    signs = {"amp": "'&'", "lt": "'<'", "gt": "'>'", "quot": "chr(34)", "apos": "chr(39)"}
    named = " ".join(f"WHEN starts_with(q, '{name};') THEN {sign} || substr(q, {len(name) + 2})" for name, sign in signs.items())
    code = "CASE WHEN lower(substr(q, 2, 1)) = 'x' THEN CAST('0x' || regexp_extract(q, '^#[xX]([0-9A-Fa-f]+)', 1) AS BIGINT) ELSE CAST(regexp_extract(q, '^#([0-9]+)', 1) AS BIGINT) END"
    number = f"WHEN NOT regexp_matches(q, '^#([xX][0-9A-Fa-f]{{1,6}}|[0-9]{{1,7}});') THEN '&' || q WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INT)) || regexp_replace(q, '^[^;]*;', '') ELSE '&' || q"
    return f"array_to_string(list_transform(string_split({value}, '&'), lambda q, i: CASE WHEN i = 1 THEN q {named} {number} END), '')"


def _sql_walked(way: str) -> str:
    """``way`` begins with a slash."""
    kept = f"""list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(substr({way}, 2), '/'), lambda x: [x])),
 lambda own, x: CASE WHEN x[1] = '..' THEN CASE WHEN len(own) < 2 THEN []::VARCHAR[] ELSE list_slice(own, 1, len(own) - 1) END WHEN x[1] = '.' THEN own ELSE list_concat(own, x) END)"""
    return rf"'/' || array_to_string({kept}, '/') || CASE WHEN regexp_matches({way}, '/\.{{1,2}}$') AND len({kept}) > 0 THEN '/' ELSE '' END"


#: Twin of the query over ``pages`` with ``RULES``.
SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
parts AS (SELECT *, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM p),
split AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
nodes AS (SELECT *, CASE WHEN position('://' IN url) > 0 THEN host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) END AS node FROM split),
tags AS (SELECT node, host, path, rest, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM nodes WHERE node IS NOT NULL),
raw AS (SELECT node, host, path, rest AS own, CASE
  WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(lower(@rel@), '\s+'), 'canonical') THEN @canonical@
  WHEN regexp_matches(tag, '(?i)^<meta') AND lower(@equiv@) = 'refresh' THEN trim(regexp_replace(@refresh@, '^(?:"([^"'']*)"|''([^"'']*)'').*$', '\1\2')) END AS link FROM tags),
hrefs AS (SELECT *, regexp_extract(link, '^[^?#]*') AS way, regexp_extract(link, '[?#].*$') AS tail, regexp_extract(path, '^(.*/)?') AS folder FROM raw WHERE link <> ''),
ways AS (SELECT *, CASE WHEN starts_with(way, '/') THEN way ELSE CASE WHEN folder = '' THEN '/' ELSE folder END || way END AS from_root FROM hrefs),
full_ AS (SELECT node, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(link, position('://' IN link) + 3)
 WHEN starts_with(link, '//') THEN substr(link, 3) WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
 ELSE host || CASE WHEN way <> '' THEN @walked@ || tail WHEN starts_with(tail, '?') THEN path || tail ELSE path || regexp_extract(own, '^[^?#]*(\?[^#]*)?', 1) || tail END END AS rest FROM ways),
edges AS (SELECT DISTINCT node AS a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
 || CASE WHEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END || regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS b FROM full_ WHERE rest IS NOT NULL),
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
spread AS (SELECT a AS node, bool_or(v = 'allow') AS allowed, bool_or(v = 'block') AS blocked FROM (SELECT a, CASE
 WHEN regexp_matches(b, '^([^/]*\.)?example\.net/en/') THEN 'allow' WHEN regexp_matches(b, '^([^/]*\.)?example\.com/de/') THEN 'block'
 WHEN regexp_matches(b, '^([^/]*\.)?org/fr/') THEN 'allow' WHEN regexp_matches(b, '^([^/]*\.)?net/') THEN 'block' END AS v FROM reach) GROUP BY a),
ruled AS (SELECT *, CASE
 WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM nodes)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN spread USING (node)
"""

_CONTENT = rf"regexp_extract({_sql_attribute('content')}, '(?i)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(.*)$', 1)"
for _mark, _part in (("rel", _sql_attribute("rel")), ("equiv", _sql_attribute("http-equiv")), ("canonical", _sql_decoded(_sql_attribute("href"))),
                     ("refresh", _sql_decoded(_CONTENT)), ("walked", _sql_walked("from_root"))):
    SQL = SQL.replace(f"@{_mark}@", _part)
