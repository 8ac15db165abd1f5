"""Stems of English words by the published suffix rules (Porter's second algorithm), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm: words with stems of their own, words left alone, words done after the first step.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ALONE = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
DONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Endings and what stands for them, in the first region of a word; endings that go in the second.
SECOND = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT = f"(?:^{VOWEL}{OTHER}|{OTHER}{VOWEL}[^aeiouywxY])$"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _ending(word: Column, endings) -> Column:
    """The longest of the endings that a word has, empty for none."""
    return F.regexp_extract(word, f"(?:{'|'.join(sorted(endings, key=len, reverse=True))})$", 0)


def _without(word: Column, ending: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(ending))


def _region(word: Column) -> Column:
    """Where what follows the first other letter after a vowel begins; the word's length if there is none."""
    head = F.regexp_extract(word, f"^.*?{VOWEL}{OTHER}", 0)
    return F.when(head == "", F.length(word)).otherwise(F.length(head))


def _start(word: Column) -> Column:
    """w (each y that is no vowel as Y), and where its first and second region begin."""
    marked = F.regexp_replace(word, f"(?<={VOWEL})y|^y", "Y")

    def regions(w: Column) -> Column:
        known = F.regexp_extract(w, "^(?:gener|commun|arsen)", 0)
        first = F.when(known != "", F.length(known)).otherwise(_region(w))
        return _let(first, lambda p: F.struct(w.alias("w"), p.alias("p"), (p + _region(F.substring(w, p + 1, F.length(w)))).alias("q")))

    return _let(marked, regions)


def _step(change):
    """A step of the algorithm: a new word, the regions as they were."""
    return lambda s: F.struct(change(s).alias("w"), s["p"].alias("p"), s["q"].alias("q"))


def _plural(s: Column) -> Column:
    w = s["w"]
    ied = F.when(F.length(w) > 4, F.regexp_replace(w, "ie[ds]$", "i")).otherwise(F.regexp_replace(w, "ie[ds]$", "ie"))
    return F.when(w.endswith("sses"), F.regexp_replace(w, "sses$", "ss")).when(w.rlike("ie[ds]$"), ied).when(w.rlike("(?:us|ss)$"), w).when(w.rlike(f"{VOWEL}.+s$"), F.regexp_replace(w, "s$", "")).otherwise(w)


def _past(s: Column) -> Column:
    w = s["w"]
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))

    def of(x: Column) -> Column:
        stem, end = x["stem"], x["e"]
        fixed = F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(stem.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.regexp_replace(stem, ".$", "")).when(stem.rlike(_SHORT) & (s["p"] >= F.length(stem)), F.concat(stem, F.lit("e"))).otherwise(stem)
        eed = F.when(F.length(stem) >= s["p"], F.concat(stem, F.lit("ee"))).otherwise(w)
        return F.when(end == "", w).when(end.startswith("eed"), eed).when(stem.rlike(VOWEL), fixed).otherwise(w)

    return _let(_let(e, lambda e: F.struct(e.alias("e"), _without(w, e).alias("stem"))), of)


def _derived(table: dict[str, str]):
    said = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))

    def change(s: Column) -> Column:
        w = s["w"]

        def of(e: Column) -> Column:
            stem = _without(w, e)
            good = (e != "") & (F.length(stem) >= s["p"])
            good = good & ((e != "ogi") | stem.endswith("l")) & ((e != "li") | stem.rlike("[cdeghkmnrt]$")) & ((e != "ative") | (F.length(stem) >= s["q"]))
            return F.when(good, F.concat(stem, F.element_at(said, e))).otherwise(w)

        return _let(_ending(w, table), of)

    return change


def _removed(s: Column) -> Column:
    w = s["w"]

    def of(e: Column) -> Column:
        stem = _without(w, e)
        return F.when((e != "") & (F.length(stem) >= s["q"]) & ((e != "ion") | stem.rlike("[st]$")), stem).otherwise(w)

    return _let(_ending(w, FOURTH), of)


def _last(s: Column) -> Column:
    w = s["w"]
    stem = F.regexp_replace(w, ".$", "")
    n = F.length(w) - 1
    e = w.endswith("e") & ((n >= s["q"]) | ((n >= s["p"]) & ~stem.rlike(_SHORT)))
    return F.when(e | (w.endswith("ll") & (n >= s["q"])), stem).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of an English word in small letters; words of one or two letters stay."""
    tail = (_past, lambda s: F.regexp_replace(s["w"], "(?<=.[^aeiouy])[yY]$", "i"), _derived(SECOND), _derived(THIRD), _removed, _last)

    def rest(s: Column) -> Column:
        out = s
        for change in tail:
            out = _let(out, _step(change))
        return F.when(s["w"].isin(*DONE), s["w"]).otherwise(F.lower(out["w"]))

    found = _let(_let(_start(word), _step(_plural)), rest)
    own = F.try_element_at(F.create_map(*(F.lit(x) for kv in OWN.items() for x in kv)), word)
    return F.when(F.length(word) <= 2, word).when(word.isin(*ALONE), word).otherwise(F.coalesce(own, found))
