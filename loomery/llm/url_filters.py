"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` plus the literal tokens
that any matching URL must contain; a rule with alternatives is indexed by each of
them apart. Token frequencies over the pages choose the rarest token; a URL's tokens
then look up the few rules that could match, and only those run their expression. The
lookup goes to one of many small tables by the token's checksum, so its cost does not
grow with the rules. Everything stays in SQL functions and needs no shuffle beyond one
small count of the rules' own tokens.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
gets the default verdict; repeated rows are judged alike; an empty table gives an
empty result; other columns pass through untouched unless their name is one of
the five result columns, which are then replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.columns import fresh

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules held in one literal index; longer lists are judged in slices of this size.
SLICE = 2000


@dataclass(frozen=True)
class UrlRule:
    """``name`` is what results show; ``listed`` rules outrank mere patterns."""

    name: str
    action: str
    regex: str
    literals: tuple[str, ...]
    listed: bool = True


def site_rule(action: str, host: str, path: str) -> UrlRule:
    """A rule on a host, all its subdomains, and a path prefix."""
    whole = f"{host}{path}"
    literals = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<=/)[a-z0-9]+(?=/)", path.lower())
    return UrlRule(whole, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(literals))


def pattern_rule(action: str, name: str, regex: str, literals: Sequence[str]) -> UrlRule:
    """A free pattern; ``literals`` are tokens present in every match."""
    return UrlRule(name, action, regex, tuple(literals), listed=False)


#: The site rules judged by the query.
SITE_RULES = (
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)
#: Words of unwanted hosts by kind: parts of host names between dots and dashes. Taken from no data; a parameter of the filter.
HOST_WORDS = {
    "gambling": "casino casinos poker roulette jackpot slots slot betting bet bookmaker sportsbook lottery lotto bingo blackjack baccarat gambling wager",
    "adult": "porn porno xxx sex sexy adult escort escorts nude nudes hentai camgirls webcams milf erotic fetish",
    "advertising": "ads ad adserver adserv adsrv adtrack adtech adsystem adnetwork advert adverts advertising banner banners popunder popup clicktrack clicks doubleclick sponsored",
    "tracking": "track tracker trackers tracking pixel pixels beacon beacons telemetry stats counter metrics analytics",
    "pills": "pills pill viagra cialis levitra pharmacy pharma drugstore meds tramadol xanax steroids cheap-pills",
    "spam farm": "spam spam-farm linkfarm link-farm backlinks seo-links article-farm content-farm doorway",
    "fraud": "phish phishing scam payday-loan quick-loans easy-money get-rich free-money replica replicas fake-id counterfeit",
    "warez": "warez crack cracks keygen keygens serials torrent torrents nulled pirate",
    "proxy": "proxy proxies anonymizer unblocker webproxy",
    "parked": "parked parking domain-for-sale buy-domain expired-domain",
}
#: Words of paths that hold no documents, as whole segments or before an extension.
PATH_WORDS = {
    "session page": "login signin sign-in logon signup sign-up logout signout register registration password-reset forgot-password oauth sso auth",
    "shop page": "cart basket checkout wishlist order-tracking add-to-cart",
    "search page": "search searchresults search-results advanced-search",
    "admin page": "admin wp-admin wp-login wp-json cgi-bin phpmyadmin cpanel",
    "feed": "rss atom feed feeds xmlrpc",
}
#: Endings of files that are no pages.
SUFFIXES = {
    "image": "jpg jpeg png gif webp svg ico bmp tiff",
    "archive": "zip gz tgz rar 7z bz2 xz iso dmg",
    "program": "exe msi apk deb rpm jar dll",
    "media": "mp3 mp4 avi mov mkv wav ogg flac webm",
    "asset": "css js map woff woff2 ttf eot",
    "office file": "pdf doc docx xls xlsx ppt pptx odt",
}


def word_rules() -> tuple[UrlRule, ...]:
    """One rule for each word of the tables: within host names, as a segment of a path, or as its ending; any case of letters."""
    out = []
    parts = lambda w: tuple(re.findall("[a-z0-9]+", w))
    for kind, words in HOST_WORDS.items():
        out += [pattern_rule("block", kind, rf"(?i)^(?:[^/]*[.-])?{re.escape(w)}(?:[.-][^/]*)?(?:/|$)", parts(w)) for w in words.split()]
    for kind, words in PATH_WORDS.items():
        out += [pattern_rule("block", kind, rf"(?i)/{re.escape(w)}(?:[/.]|$)", parts(w)) for w in words.split()]
    for kind, words in SUFFIXES.items():
        out += [pattern_rule("block", kind, rf"(?i)/[^/]*\.{w}$", parts(w)) for w in words.split()]
    return tuple(out)


PATTERN_RULES = word_rules()


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(key), "[^a-z0-9]+"), ""))


def rarest_literals(keys: DataFrame, rules: Sequence[UrlRule]) -> dict[int, str]:
    """For each rule the literal that the fewest URLs hold; the driver gets one count per literal."""
    literals = sorted({t for r in rules for t in r.literals})
    counts: dict[str, int] = {}
    for at in range(0, len(literals), SLICE):
        part = literals[at : at + SLICE]
        found = keys.select(F.explode(F.array_intersect(_tokens(F.col("key")), _table(part, "array<string>"))).alias("token"))
        counts |= {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}
    return {i: min(r.literals, key=lambda t: (counts.get(t, 0), t)) for i, r in enumerate(rules) if r.literals}


def _table(value: list, kind: str) -> Column:
    """A constant of nested arrays and maps; one literal, however many rules it holds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _best(key: Column, tokens: Column, rules: Sequence[tuple[int, UrlRule]], rarest: dict[int, str]) -> Column:
    """The strongest matching rule of one slice as struct(listed, length, ordinal), or null."""
    index: dict[str, list[int]] = {}
    free: list[int] = []
    for place, (ordinal, rule) in enumerate(rules):
        index.setdefault(rarest[ordinal], []).append(place) if ordinal in rarest else free.append(place)
    places = _table(free, "array<int>")
    if index:
        parts: list[dict] = [{} for _ in range(2 * len(index))]
        for t, ps in sorted(index.items()):
            parts[zlib.crc32(t.encode()) % len(parts)][t] = ps
        lookup = _table([part or None for part in parts], "array<map<string,array<int>>>")
        held = lambda t: F.try_element_at(F.get(lookup, (F.crc32(t.cast("binary")) % len(parts)).cast("int")), t)
        fetched = F.transform(tokens, lambda t: F.coalesce(held(t), F.array().cast("array<int>")))
        places = F.concat(places, F.flatten(fetched))
    regexes = _table([r.regex for _, r in rules], "array<string>")
    ranks = _table([{"listed": int(r.listed), "size": len(r.name), "ordinal": o} for o, r in rules], "array<struct<listed:int,size:int,ordinal:int>>")
    hits = F.filter(F.array_distinct(places), lambda p: F.rlike(key, F.get(regexes, p)))
    return F.array_max(F.transform(hits, lambda p: F.get(ranks, p)))


def judge_urls(pages: DataFrame, site_rules: Sequence[UrlRule] = SITE_RULES, patterns: Sequence[UrlRule] = PATTERN_RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule, pattern and verdict to ``pages``."""
    rules = [*site_rules, *patterns]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rarest = rarest_literals(pages.select(F.concat(host, path).alias("key")), rules)
    numbered = list(enumerate(rules))
    slices = [numbered[i : i + SLICE] for i in range(0, len(numbered), SLICE)]
    out = pages.withColumns({"host": host, "path": path})
    key = F.concat("host", "path")
    bests = [_best(key, _tokens(key), part, rarest) for part in slices]
    best = F.array_max(F.array(*bests)) if bests else F.lit(None).cast("struct<listed:int,size:int,ordinal:int>")
    names, actions = _table([r.name for r in rules], "array<string>"), _table([r.action for r in rules], "array<string>")
    (name,) = fresh([*out.columns, "rule", "pattern", "verdict"], "best")
    out = out.withColumn(name, best)
    at = F.col(f"{name}.ordinal")
    return out.withColumns(
        {
            "rule": F.when(F.col(f"{name}.listed") == 1, F.get(names, at)),
            "pattern": F.when(F.col(f"{name}.listed") == 0, F.get(names, at)),
            "verdict": F.coalesce(F.get(actions, at), F.lit(default)),
        }
    ).drop(name)
