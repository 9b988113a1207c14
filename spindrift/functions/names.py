"""Names of entities: identifiers, normal forms, and the three ways in which names are said to match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.columns import mapped, words
from spindrift.functions.text import squash, strip

#: Words dropped from the front of a name, each tried once in this order.
LEADS = ["the ", "a ", "an ", "this ", "these ", "those "]
#: Agent nouns and the word they count as.
AGENTS = {"attacker": "attack", "attackers": "attack", "attacks": "attack", "attacking": "attack", "hacker": "hack", "hackers": "hack", "hacking": "hack", "researcher": "research", "researchers": "research", "operator": "operate", "operators": "operate", "threat": "threat_actor"}


def node_id(kind: Column, name: Column) -> Column:
    """The node's identifier: its type in lower case and its name without brackets, quotes, commas."""
    return F.concat(F.lower(kind), F.lit(":"), F.translate(F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_")), "()'\",;", ""))


def for_match(name: Column) -> Column:
    """Lower case, leading articles and demonstratives dropped, white space collapsed."""
    return squash(F.regexp_replace(F.lower(F.trim(name)), "^" + "".join(f"(?:{lead})?" for lead in LEADS), ""))


def for_comparison(name: Column) -> Column:
    """Lower case without a leading article and without punctuation."""
    return strip(F.translate(F.regexp_replace(F.lower(F.trim(name)), "^(?:the )?(?:a )?", ""), "()'\",;.-_", ""))


def alnum_words(name: Column) -> Column:
    """Lower case, all but ASCII letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def stem(word: Column) -> Column:
    """A word without its plural ending."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.substr(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("ses") | word.endswith("xes") | word.endswith("zes"), F.substr(word, F.lit(1), n - 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), F.substr(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def token_set(name: Column, stemmed: bool = False) -> Column:
    """The distinct words of a normalised name."""
    parts = words(name)
    if stemmed:
        parts = F.transform(parts, lambda w: mapped(stem(w), AGENTS, stem(w)))
    return F.array_distinct(parts)


def names_match(a: Column, b: Column, ta: Column, tb: Column, share: float) -> Column:
    """Equal, one inside the other, or ``share`` of the shorter one's words in the longer one."""
    smaller = F.least(F.size(ta), F.size(tb))
    return (a == b) | b.contains(a) | a.contains(b) | ((smaller > 0) & (F.size(F.array_intersect(ta, tb)) / F.greatest(smaller, F.lit(1)) >= share))


def clean_name(name: Column) -> Column:
    """Without a leading article, a trailing qualifier and a lead-in on what attackers do."""
    name = F.regexp_replace(name, r"(?is)^(?:the (?=.{3}))?(?:a (?=.{3}))?(?:an (?=.{3}))?", "")
    name = F.regexp_replace(name, r"\s+(?:for|from|against|on|in|of|by|via|through|within|across)\s+(?:the\s+)?(?:[A-Z]|\w{2,}).*$", "")
    name = F.regexp_replace(name, r"^(?i)(?:threat actors? to execute|attackers? to execute|allows? (?:attackers?|threat actors?) to (?:execute|run|deploy))\s+", "")
    return strip(name)
