"""Names of persons, offices and districts as column expressions: title case, parts of a name, rule tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of Roman digits that are no numbers, two-letter words in capitals, two-letter words that are not.
NOT_ROMAN = ("vi", "xi", "di", "mi", "im", "id", "ci", "li")
CAPITALS, NO_CAPITALS = ("aj", "oj"), ("jr", "sr", "dr")
#: First names of two words.
FIRST_NAMES = ("Anne Marie", "Ann Marie", "Leigh Ann", "Mary Anne", "Mary Ann", "Le Andra", "Lee Ann", "Jo Ann", "Anita Jo", "Dee Dee")
#: Beginnings of surnames of several words and how they are written, in the order in which they are tried.
SURNAMES = (("de\\s+la", "De La"), ("van\\s+de", "Van De"), ("de", "De"), ("di", "Di"), ("san", "San"))

_PART = "[\\w.'-]+"
_WITH_MARKS = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in range(0xC0, 0x250)}
_PLAIN = {c: d[0] for c, d in _WITH_MARKS.items() if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])}


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks, and without combining marks."""
    return F.regexp_replace(F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values())), "[\\u0300-\\u036F]", "")


def slug_of_words(text: Column) -> Column:
    """Letters without their marks and digits in small letters, one hyphen for whatever stands between."""
    return F.btrim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 10_000)))


def _segment(s: Column) -> Column:
    low = F.lower(s)
    roman = s.rlike("(?i)^[IVXLCDM]+$") & ~low.isin(*NOT_ROMAN)
    capitals = low.isin(*CAPITALS) | (low.rlike("^[b-df-hj-np-tv-z]{2}$") & ~low.isin(*NO_CAPITALS))
    special = lambda n: _capital(F.substring(s, n, 10_000))
    return F.when(roman | capitals, F.upper(s)).when(low.rlike("^mc."), F.concat(F.lit("Mc"), special(3))).when(low.rlike("^o'."), F.concat(F.lit("O'"), special(3))).otherwise(_capital(s))


def _phrase(text: Column) -> Column:
    def word(w: Column) -> Column:
        kept = w.rlike('^".*"$') | w.startswith("(") | w.endswith(")")
        parts = F.transform(F.split(w, "-"), lambda p: F.array_join(F.transform(F.split(p, "\\."), _segment), "."))
        return F.when(kept & (F.length(w) > 0), w).otherwise(F.array_join(parts, "-"))

    return F.array_join(F.transform(F.filter(F.split(text, "\\s+"), lambda w: w != ""), word), " ")


def title_case(text: Column) -> Column:
    """Words with a capital: Roman numbers and pairs of consonants in capitals, Mc and O' in their form, also within hyphens, points, quotes and parentheses."""
    quoted = '[("]([^")]*)[")]'

    def of(s: Column) -> Column:
        inner = F.transform(F.regexp_extract_all(s, F.lit(f"({quoted})"), 1), lambda q: F.concat(F.substring(q, 1, 1), _phrase(F.regexp_extract(q, quoted, 1)), F.when(q.startswith('"'), '"').otherwise(")")))
        outer = F.split(s, quoted)
        return _phrase(F.array_join(F.flatten(F.transform(F.arrays_zip(outer.alias("o"), inner.alias("i")), lambda z: F.array(z["o"], F.coalesce(z["i"], F.lit(""))))), ""))

    return _let(F.regexp_replace(text, '\\(\\s*"([^"]*)"\\s*\\)', "($1)"), of)


def normalize_name(text: Column) -> Column:
    """Without accents, curly quotes, "Dr." outside quotes, doubled blanks and blanks around hyphens."""
    s = F.regexp_replace(F.replace(strip_accents(text), F.lit("''"), F.lit('"')), "[\\u201C\\u201D\\u201E\\u201F]", '"')
    s = F.regexp_replace(s, "(\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|\\([^)]*(?:\\)|$))|(?i:dr\\.)", "$1")
    return F.regexp_replace(F.trim(F.regexp_replace(s, "\\s+", " ")), " *- *", "-")


def _cut(s: Column, pattern: str) -> tuple[Column, Column, Column]:
    """What stands before and after the first match of a pattern, and whether there is one."""
    at, whole = F.regexp_instr(s, F.lit(pattern)), F.regexp_extract(s, pattern, 0)
    return F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(whole), F.lit(10_000)), at > 0


def _initial(m: Column) -> Column:
    return F.when(F.length(m) == 1, F.concat(m, F.lit("."))).otherwise(F.nullif(m, F.lit("")))


def person_name(text: Column) -> Column:
    """A name's parts, a struct of first, last, middle, preferred and suffix; null if what stands for the first name is no word."""
    nickname = "\"([^\"]+)\"|'([^']+)'|\\(([^)]+)\\)"
    suffix = ",?\\s+([iIvVxX]+|[jJsS][rR]\\.?)$"

    def without_nickname(s: Column) -> Column:
        before, after, there = _cut(s, nickname)
        said = F.trim(F.concat(*(F.regexp_extract(s, nickname, k) for k in (1, 2, 3))))
        left = F.trim(F.regexp_replace(F.concat_ws(" ", F.rtrim(before), F.ltrim(after)), "\\s+", " "))
        return F.struct(F.when(there, left).otherwise(s).alias("s"), F.when(there, said).alias("preferred"))

    def without_suffix(p: Column) -> Column:
        s = p["s"]
        before, _, there = _cut(s, suffix)
        said = F.regexp_extract(s, suffix, 1)
        said = F.when(F.lower(said).isin("jr", "sr"), F.concat(said, F.lit("."))).otherwise(said)
        return F.struct(F.when(there, F.trim(before)).otherwise(s).alias("s"), p["preferred"].alias("preferred"), F.when(there, said).alias("suffix"))

    def without_surname(p: Column) -> Column:
        s = p["s"]
        rest, last = None, None
        ways = [(f"(?iU)\\s+{start}\\s+({_PART})$", F.concat(F.lit(f"{written} "), F.regexp_extract(s, f"(?iU)\\s+{start}\\s+({_PART})$", 1))) for start, written in SURNAMES]
        other = f"(?iU)\\s+(van|von|del|st\\.?)\\s+({_PART})$"
        start = F.regexp_extract(s, other, 1)
        start = F.when(F.lower(start) == "st", F.concat(start, F.lit("."))).otherwise(start)
        ways.append((other, F.concat(start, F.lit(" "), F.regexp_extract(s, other, 2))))
        for pattern, said in ways:
            before, _, there = _cut(s, pattern)
            rest = F.when(there, F.trim(before)) if rest is None else rest.when(there, F.trim(before))
            last = F.when(there, said) if last is None else last.when(there, said)
        word = F.element_at(F.split(s, " "), -1)
        plain = (F.length(word) > 2) | ((F.length(word) == 2) & ~word.endswith("."))
        rest = rest.when(plain, F.trim(F.substring(s, F.lit(1), F.length(s) - F.length(word)))).otherwise(s)
        return F.struct(rest.alias("s"), p["preferred"].alias("preferred"), p["suffix"].alias("suffix"), last.when(plain, word).alias("last"))

    def parts(p: Column) -> Column:
        words = F.split(p["s"], " ")
        two = F.lower(F.array_join(F.slice(words, 1, 2), " "))
        known = two.isin(*(x.lower() for x in FIRST_NAMES)) & (F.size(words) >= 2)
        rest = lambda n: F.array_join(F.slice(words, n, 1000), " ")
        first = F.when(known, title_case(two)).otherwise(F.element_at(words, 1))
        middle = F.when(known, _initial(title_case(rest(3)))).otherwise(_initial(rest(2)))
        good = known | p["s"].rlike(f"(?U)^{_PART}(?: +{_PART})*$")
        return F.when(good, F.struct(first.alias("first"), p["last"].alias("last"), middle.alias("middle"), p["preferred"].alias("preferred"), p["suffix"].alias("suffix")))

    s = F.regexp_replace(normalize_name(text), '\\(\\s*"([^"]*)"\\s*\\)', "($1)")
    return _let(_let(_let(_let(s, without_nickname), without_suffix), without_surname), parts)


#: Pattern of a contest title, office name, title, chamber, district type, political scope, election scope. The first match wins.
CO_OFFICES = (
    ("U(?:nited |.)S(?:tates|.) Senat(?:e|or)", "U.S. Senate", "U.S. Senator", "senate", "state_senate", "federal", "state"),
    ("U(?:nited |.)S(?:tates|.) (?:House|Representative)", "U.S. House", "U.S. Representative", "house", "us_congressional", "federal", "district"),
    ("State Senat(?:e|or)", "State Senate", "State Senator", "senate", "state_house", "state", "district"),
    ("State (?:House|Representative)", "State House", "State Representative", "house", "state_house", "state", "district"),
    ("Board of Education", "Board of Education", "Board of Education Member", None, "us_congressional", "local", "district"),
    ("(?:Board of Regents|Regent of (?:the )?University)", "Board of Regents", "Regent", None, "us_congressional", "local", "district"),
    ("District Attorney", "District Attorney", "District Attorney", None, "judicial", "local", "district"),
    ("District Court Judge", "District Court Judge", "District Court Judge", None, "judicial", "local", "district"),
    ("County Court Judge", "County Court Judge", "County Court Judge", None, None, "local", "county"),
    ("Court of Appeals Judge", "Court of Appeals Judge", "Court of Appeals Judge", None, None, "state", "state"),
    ("Supreme Court Justice", "Supreme Court Justice", "Supreme Court Justice", None, None, "state", "state"),
    ("Regional Transportation District Director", "Regional Transportation District Director", "Regional Transportation District Director", None, "transportation", "state", "district"),
)
OFFICE_PARTS = ("name", "title", "chamber", "district_type", "political_scope", "election_scope")


def co_office(title: Column, rules=CO_OFFICES) -> Column:
    """What a contest title says of its office, a struct of ``OFFICE_PARTS`` by an ordered table of patterns; null if none matches."""
    out = None
    for pattern, *values in rules:
        meta = F.struct(*(F.lit(v).cast("string").alias(k) for k, v in zip(OFFICE_PARTS, values, strict=True)))
        test = title.rlike(f"(?i){pattern}")
        out = F.when(test, meta) if out is None else out.when(test, meta)
    return out


def co_district(title: Column) -> Column:
    found = [F.nullif(F.regexp_extract(title, p, 1), F.lit("")) for p in ("District (\\d+[A-Z]?|[A-Z]+)(?:\\W|$)", "(\\d+)(?:st|nd|rd|th) (?:\\w+ )?District")]
    return F.coalesce(*found)


def co_seat(title: Column) -> Column:
    return F.when(title.rlike("(?:\\W|^)(?i:At Large)(?:\\W|$)"), "At Large")


def without_zeros(code: Column) -> Column:
    return F.regexp_replace(code, "^0+", "")


def ward(code: Column) -> Column:
    """The part after the first hyphen, or all of it, without leading zeros."""
    return without_zeros(F.regexp_replace(code, "^[^-]*-", ""))


def district_or_direction(text: Column) -> Column:
    """The number after "District", without zeros, or a direction, whichever comes first."""
    pattern = "District\\s*(\\d+)|(East|West|North|South)"
    s = without_zeros(text)
    number = F.regexp_extract(s, pattern, 1)
    return F.when(number != "", without_zeros(number)).otherwise(F.nullif(F.regexp_extract(s, pattern, 2), F.lit("")))


def listed(text: Column) -> Column:
    """The parts of a list with commas, blanks around them and empty ones left out; of null, none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


#: What an address of a site may hold to be of each kind.
SOCIAL = {"facebook": ("facebook.com",), "twitter": ("twitter.com", "x.com"), "instagram": ("instagram.com",), "tiktok": ("tiktok.com",), "youtube": ("youtube.com",), "linkedin": ("linkedin.com",)}
CAMPAIGN_WORDS = ("congress", "texas")


def site_kind(url: Column, title: Column, names: Column, words=CAMPAIGN_WORDS) -> Column:
    """social, encyclopedia, official, campaign or other. A campaign's address or title holds one of ``names`` and one of ``words``; without names any does."""
    low = F.lower(url)
    any_of = lambda s, parts: F.coalesce(F.exists(F.array(*map(F.lit, parts)), lambda p: s.contains(p)), F.lit(False))
    both = F.concat(low, F.lit(" "), F.lower(F.coalesce(title, F.lit(""))))
    parts = F.filter(F.transform(names, lambda n: F.lower(F.trim(n))), lambda n: n.isNotNull() & (n != ""))
    campaign = (F.size(parts) == 0) | (F.exists(parts, lambda n: both.contains(n)) & any_of(both, words))
    social = [x for kinds in SOCIAL.values() for x in kinds]
    return F.when(any_of(low, social), "social").when(low.contains("ballotpedia.org"), "encyclopedia").when(low.contains(".gov"), "official").when(campaign, "campaign").otherwise("other")


def social_links(html: Column) -> Column:
    """The first link of a page to each network, a struct."""
    links = F.regexp_extract_all(html, F.lit("(?i)href=[\"']([^\"']+)[\"']"), 1)
    first = lambda hosts: F.try_element_at(F.filter(links, lambda u: u.rlike("(?i)^https?://(?:[a-z0-9-]+\\.)*(?:" + "|".join(h.replace(".", "\\.") for h in hosts) + ")(?:[/?#]|$)")), F.lit(1))
    return F.struct(*(first(hosts).alias(k) for k, hosts in SOCIAL.items()))


def emails(html: Column) -> Column:
    """The addresses of a page's mail links and text, small letters, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit("([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,})"), 1), lambda x: F.lower(x)))


def years_in_office(experience: Column, this_year: Column) -> Column:
    """Years over an array of structs with title and span ("2001-2005", "2015-present", "2019"), candidacies left out; of null, null."""
    def years(span: Column) -> Column:
        ends = F.transform(F.split(span, "-"), lambda x: F.coalesce(F.trim(x).try_cast("int"), this_year))
        return F.abs(F.coalesce(F.try_element_at(ends, F.lit(2)), this_year) - F.element_at(ends, 1))

    held = F.filter(experience, lambda e: F.coalesce(e["title"], F.lit("")) != "Candidate")
    return F.aggregate(F.transform(held, lambda e: F.coalesce(years(e["span"]), F.lit(0))), F.lit(0), lambda a, x: a + x)


def career_years(experience: Column, this_year: Column) -> Column:
    """Years of a career as JSON: an array as in ``years_in_office``, one object whatever its title, 0 for anything else; of null, null."""
    entry = "struct<title: string, span: string>"

    def told(v: Column) -> Column:
        many, one = F.try_variant_get(v, "$", f"array<{entry}>"), F.try_variant_get(v, "$", entry)
        mandate = F.array(F.struct(F.lit("").alias("title"), one["span"].alias("span")))
        kind = F.schema_of_variant(v)
        return F.when(kind.startswith("ARRAY"), years_in_office(many, this_year)).when(kind.startswith("OBJECT"), years_in_office(mandate, this_year)).otherwise(0)

    return F.when(experience.isNotNull(), F.coalesce(_let(F.try_parse_json(experience), told), F.lit(0)))
