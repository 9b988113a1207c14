"""Spellings that mean the same organisation or person (noisy-channel attribution).

A spelling is taken as a canonical name that went through a channel: typing errors, abbreviations,
short forms of given names, dropped and reordered parts. Attribution goes from tokens to names:

1. A token is a common word (given name, trade, legal form) if it stands beside many different
   distinctive tokens, slips counted with what they are near. How many spellings hold it does not
   matter: a name of thousands of spellings has few companions, whatever else the table holds.
   Each name's distinctive token is among the other tokens.
2. Each token is attached to the candidate of highest posterior: the prior is its frequency, the
   likelihood falls with every edit. Candidates come from an equi-join on deletion variants. An
   unknown long token next to a frequent one is far likelier a slip than a new name, so the token
   itself is a candidate of low prior. What a token is attached to may be a slip as well: links are
   followed to their ends. Listed abbreviations and short forms are certain and written out.
3. A name is its distinctive token and its core: the other words without legal forms. The cores that
   occur with a distinctive token are the canonical names, each with its frequency for a prior.
   Every name is attached to the one of highest posterior: itself, one of which it has dropped a
   word, or, if it has initials only or nothing for a core, those of these initials or all. Initials
   count in the order written: the first is the given name's, a later one hardly ever.
4. A name between equals is attached to none of them.

All steps are joins and aggregations with bounded rows per key; no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import fold, strip
from spindrift.lineage import written
from spindrift.llm.edits import near
from spindrift.operators.skew import hot_keys, lookup

#: Strings that name nothing.
NO_NAME = ["", "n/a", "unknown", "-"]

#: Abbreviations of business words and how they are written out.
ABBREVIATIONS = {
    "corp": "corporation", "co": "company", "inc": "incorporated", "ltd": "limited", "intl": "international",
    "tech": "technologies", "techn": "technologies", "technology": "technologies", "hldgs": "holdings", "hldg": "holdings", "natl": "national",
    "inst": "institute", "min": "ministry", "transp": "transport", "univ": "university", "bros": "brothers",
    "assoc": "association", "dept": "department", "govt": "government", "mfg": "manufacturing", "svcs": "services", "serv": "services",
    "telecomm": "telecom", "ins": "insurance", "bdcst": "broadcasting", "bcast": "broadcasting", "pharm": "pharma", "grp": "group",
}

#: Short forms of given names.
SHORT_FORMS = {
    "alex": "alexander", "sandy": "alexander", "sasha": "alexander", "xander": "alexander", "andy": "andrew", "drew": "andrew", "tony": "anthony", "ben": "benjamin",
    "charlie": "charles", "chuck": "charles", "chris": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david",
    "ed": "edward", "eddie": "edward", "ted": "edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth",
    "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "greg": "gregory", "jim": "james", "jimmy": "james", "jen": "jennifer", "jenny": "jennifer",
    "jack": "john", "johnny": "john", "joe": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kath": "katherine", "kit": "katherine",
    "larry": "lawrence", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "peg": "margaret", "greta": "margaret", "mike": "michael", "mick": "michael", "mickey": "michael",
    "nick": "nicholas", "pat": "patricia", "trish": "patricia", "patty": "patricia", "tricia": "patricia", "pete": "peter",
    "dick": "richard", "rick": "richard", "ricky": "richard", "rich": "richard", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert",
    "sam": "samuel", "steve": "stephen", "sue": "susanna", "susie": "susanna", "susan": "susanna", "suzy": "susanna", "thea": "theodora", "dora": "theodora", "theo": "theodora",
    "tom": "thomas", "tommy": "thomas", "bill": "william", "will": "william", "billy": "william", "willy": "william", "liam": "william",
}

#: Words that do not tell one organisation from another.
LEGAL = ["corporation", "company", "incorporated", "limited", "international", "technologies", "holdings", "group", "the", "of", "and", "de", "for"]

#: Words of institutions that are common however few names there are.
COMMON = ["national", "institute", "university", "ministry", "department", "sons", "brothers", "association", "bank", "savings", "insurance", "services", "transport", "broadcasting"]

#: Letters with marks and the letters they are often typed as.
PLAIN = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")

#: A token is common from this many narrow companions on, if they are at least half of all its companions;
#: a narrow companion has itself fewer companions than that.
LEAST_COMMON = 10
#: Shorter tokens have many neighbours by chance: a slip is taken only for something this much more frequent, as
#: logarithms by length; the ratio rises with the spellings of the token itself, up to FAR_RARER.
SHORT, SHORT_RATIO, FAR_RARER = 7, {3: 2.3, 4: 1.0, 5: 1.0, 6: 0.8}, 3.0
#: What slips of common words gain, as a logarithm: everyone writes these, so each of their slips is frequent.
COMMON_SLIP = 1.5
#: Logarithms of likelihoods: of an edit, of a word dropped from a name, of an initial that is not the first.
EDIT, DROPPED, LATER_INITIAL = -1.5, -6.0, -4.0
#: Share of a distinctive token's names that one core needs for a name without core or initials to be it.
SURE = 0.9


def _fixed(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def tokens_of(name: Column) -> Column:
    """Folded words without invisible characters and marks on letters; words glued together part at a
    capital letter."""
    parted = F.regexp_replace(F.regexp_replace(name, r"\p{Cf}", ""), r"(?<=\p{Ll}{3})(?=\p{Lu}\p{Ll}{2})", " ")
    text = F.translate(F.regexp_replace(fold(parted), r"[\p{Cf}\p{M}'’`]", ""), *PLAIN)
    text = F.regexp_replace(text, "[&+]", " and ")
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _big(df: DataFrame) -> DataFrame:
    """Never a broadcast: a stored table of tokens or names looks far smaller than it is in memory."""
    return df.hint("merge")


def _allowed(length: Column) -> Column:
    return F.when(length < 3, 0).when(length < 10, 1).otherwise(2)


def settled(links: DataFrame) -> DataFrame:
    """``links`` (a, b; one row each a, no cycles) with the end of each chain for b. Every round
    doubles the steps taken, until no link changes."""
    links = written(links)
    while True:
        onward = links.select(F.col("a").alias("b"), F.col("b").alias("_end"))
        links = written(links.join(_big(onward), "b", "left").select("a", F.coalesce("_end", "b").alias("b"), (F.col("_end") != F.col("b")).alias("_moved")))
        moved = links.where("_moved").limit(1).count()
        links = links.select("a", "b")
        if not moved:
            return links


def slip_pairs(tokens: DataFrame) -> DataFrame:
    """a, b, d: each token that is not listed and the tokens a few edits from it, itself among them."""
    return written(near(tokens.where("not listed").select(F.col("token").alias("word")), tokens.select(F.col("token").alias("word")), _allowed))


def companions(each: DataFrame, tokens: DataFrame, pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """token, fold, held, companions and narrow of the tokens that are not listed: the most frequent
    token near it, and of that one the spellings, with how many different tokens it shares a spelling
    as the rarest other one, and how many of these have few companions themselves.

    So slips of a word beside a name are one companion, and slips of listed words none; a companion
    stands in two spellings at least. A spelling counts once for each of its tokens.
    """
    df = tokens.where("length(token) > 1").select("token", "df", "n")
    near_ = pairs.join(_big(df.toDF("a", "df", "n")), "a").join(_big(df.toDF("b", "b_df", "b_n")), "b").where(F.struct("b_df", "b_n", "b") >= F.struct("df", "n", "a"))
    folded = settled(near_.groupBy("a").agg(F.max_by("b", F.struct("b_df", "b_n", "b")).alias("b")))
    # Ends that are listed have no row of their own in ``folded``.
    folded = folded.join(tokens.where("listed").select(F.col("token").alias("b")), "b", "left_anti").select("a", "b")
    stands = lookup(each.select("spelling", "token"), folded.toDF("token", "fold"), "token", hot, ["spelling"]).select("spelling", F.col("fold").alias("token")).distinct()
    counts = stands.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    stands = written(lookup(stands, counts.withColumnRenamed("n", "held"), "token", written(hot_keys(counts, "token")), ["spelling"]))
    rarest = F.slice(F.array_sort(F.collect_list(F.when(F.col("held") > 1, F.struct("held", "token")))), 1, 2)
    beside = stands.join(_big(stands.groupBy("spelling").agg(rarest.alias("r"))), "spelling")
    beside = beside.select("token", F.explode(F.slice(F.filter("r", lambda x: x["token"] != F.col("token")), 1, 1)["token"]).alias("other")).distinct()
    beside = written(beside)
    width = beside.groupBy("token").agg(F.count(F.lit(1)).alias("companions"))
    others = width.where(F.col("companions") >= LEAST_COMMON).select(F.col("token").alias("other"), F.lit(1).alias("_wide"))
    narrow = beside.join(_big(others), "other", "left").groupBy("token").agg(F.count(F.lit(1)).alias("companions"), F.count(F.when(F.col("_wide").isNull(), 1)).alias("narrow"))
    of = counts.withColumnRenamed("n", "held").join(_big(narrow), "token", "left").na.fill(0).withColumnRenamed("token", "fold")
    return folded.toDF("token", "fold").join(_big(of), "fold").select("token", "fold", "held", "companions", "narrow")


def attributed_tokens(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """token, fixed, common: the token of highest posterior for each, written out if it is an abbreviation
    or short form, and whether it is a common word.

    ``tokens`` has token, df (spellings that hold it), n (occurrences), common and listed; ``pairs``
    are their ``slip_pairs``.
    """
    known = tokens.select(F.col("token").alias("b"), F.col("df").alias("c_df"), F.col("n").alias("c_n"), F.col("common").alias("c_common"))
    # Common words may be what any token is meant for, and are themselves meant for common ones only;
    # other tokens compete among themselves. Listed words are no slips; other common words are if a far
    # commoner one is near.
    open_ = tokens.where("not listed").select(F.col("token").alias("a"), "df", "n", F.col("common").alias("a_common"))
    scored = pairs.join(_big(known), "b").join(_big(open_), "a").where(
        # A slip is rarer than what was meant; between equals the first in byte order stays.
        (F.col("a") == F.col("b")) | F.col("c_common") | (~F.col("a_common") & ((F.struct("c_df", "c_n") > F.struct("df", "n")) | ((F.struct("c_df", "c_n") == F.struct("df", "n")) & (F.col("b") < F.col("a"))))))
    # What a token keeps for standing for itself: much of it if short, next to nothing if long.
    own = F.coalesce(*[F.when(F.length("a") <= k, least) for k, least in SHORT_RATIO.items()]) + EDIT
    short = own + F.least(F.log(F.col("df").cast("double")), F.lit(FAR_RARER))
    prior = F.when((F.col("a") == F.col("b")) & ~F.col("a_common"), F.when(F.length("a") < SHORT, short).otherwise(-8.0)).when((F.col("a") != F.col("b")) & F.col("c_common"), COMMON_SLIP).otherwise(0.0)
    posterior = prior + F.log(F.col("c_df").cast("double")) + EDIT * F.col("d")
    best = scored.groupBy("a").agg(F.max(F.struct(posterior.alias("p"), F.col("c_n").alias("n"), F.col("b").alias("b"))).alias("x")).select("a", F.col("x.b").alias("b"))
    ends = settled(best.where("a <> b"))
    slips = best.where("a = b").select(F.col("a").alias("token"), F.col("b").alias("fixed")).unionByName(ends.select(F.col("a").alias("token"), F.col("b").alias("fixed")))
    fixed = slips.unionByName(tokens.where("listed").select("token", F.col("token").alias("fixed"))).join(_big(known.select(F.col("b").alias("fixed"), F.col("c_common").alias("common"))), "fixed")
    # A listed abbreviation or short form is taken for what it stands for, whichever of the two is more
    # frequent: how often a table writes a word in full tells nothing about what the short form means.
    return fixed.select("token", F.coalesce(F.try_element_at(_fixed(ABBREVIATIONS | SHORT_FORMS), F.col("fixed")), F.col("fixed")).alias("fixed"), "common")


def entities_of(names: DataFrame) -> DataFrame:
    """name and entity (an identifier of what it means) of each row of ``names`` (name, n), names distinct.

    Null and placeholder names are left out. A name without a distinctive token means the same only
    as names of the same words.
    """
    names = names.where(F.col("name").isNotNull() & ~fold(strip(F.col("name"))).isin(NO_NAME))
    spelled = names.select("name", "n", tokens_of(F.col("name")).alias("words")).withColumn("spelling", F.array_join(F.concat(
        F.array_sort(F.filter("words", lambda w: F.length(w) > 1)), F.filter("words", lambda w: F.length(w) == 1)), " "))
    spelled = written(spelled)
    spellings = spelled.groupBy("spelling").agg(F.sum("n").alias("n"))
    each = spellings.select("spelling", "n", F.explode(F.array_distinct(F.split("spelling", " "))).alias("token")).where("token <> ''")
    listed = sorted({*SHORT_FORMS, *SHORT_FORMS.values(), *ABBREVIATIONS, *ABBREVIATIONS.values(), *LEGAL, *COMMON})
    tokens = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n")).select(
        "token", "df", "n", F.col("token").isin(listed).alias("listed"))
    tokens = written(tokens)
    pairs, hot = slip_pairs(tokens), written(hot_keys(tokens.select("token", F.col("df").alias("n")), "token"))
    beside = companions(each, tokens, pairs, hot)
    wide = (F.col("token") == F.col("fold")) & (F.col("narrow") >= LEAST_COMMON) & (2 * F.col("narrow") >= F.col("companions"))
    tokens = tokens.join(_big(beside), "token", "left").select(
        "token", "df", "n", "listed", F.coalesce("held", "df").alias("held"), F.coalesce("companions", F.lit(0)).alias("companions"), ((F.length("token") > 1) & (F.col("listed") | F.coalesce(wide, F.lit(False)))).alias("common"))
    tokens = written(tokens)
    # Which token is a name's root is decided by what a slip was meant for, not by the slip.
    attributed = written(attributed_tokens(tokens, pairs))
    meant = tokens.select(F.col("token").alias("fixed"), "companions", "held")
    fixed = written(attributed.join(_big(meant), "fixed", "left").na.fill(0, ["companions", "held"]))
    parts = lookup(each.select("spelling", "n", "token"), fixed, "token", hot, ["spelling"])
    shaped = parts.groupBy("spelling").agg(
        F.max("n").alias("n"),
        F.min(F.when(~F.col("common") & (F.length("fixed") > 1), F.struct("companions", (-F.col("held")).alias("d"), (-F.length("fixed")).alias("l"), F.col("fixed").alias("root")))).alias("r"),
        F.array_sort(F.collect_set("fixed")).alias("all"),
    ).select("spelling", "n", F.col("r.root").alias("root"), "all")
    core = F.filter("all", lambda w: (F.length(w) > 1) & ~w.isin(LEGAL) & ~w.eqNullSafe(F.col("root")))
    initials = F.filter(F.split("spelling", " "), lambda w: F.length(w) == 1)
    shaped = written(shaped.select("spelling", "n", "root", F.array_join(core, " ").alias("core"), initials.alias("initials"), F.array_join("all", " ").alias("all")))
    rooted = shaped.where("root is not null")
    named = rooted.join(_big(attached(rooted)), "spelling").select("spelling", F.concat_ws("\x01", "root", "meant").alias("entity"))
    ids = named.unionByName(shaped.where("root is null").select("spelling", F.concat(F.lit("\x01\x01"), F.col("all")).alias("entity")))
    blank = spelled.where("spelling = ''").select("name", F.concat(F.lit("\x01\x01\x01"), F.col("name")).alias("entity"))
    return spelled.where("spelling <> ''").join(_big(ids), "spelling").select("name", "entity").unionByName(blank)


def attached(rooted: DataFrame) -> DataFrame:
    """spelling and meant: the core of highest posterior for each of ``rooted`` (spelling, n, root, core,
    initials) among those that occur with its root.

    A core competes with those that have one word more; initials with the most frequent core of each
    letter, which no other of this letter can beat; a bare root is the core that holds ``SURE`` of its
    names. Equals leave a name with what it has.
    """
    log = lambda c: F.log(F.col(c).cast("double"))
    full = written(rooted.where("core <> ''").groupBy("root", "core").agg(F.sum("n").alias("n")))
    words = F.split("core", " ")
    # A core with one of its words dropped: an equi-join, as with the letters of tokens.
    fewer = full.where(F.size(words) > 1).select("root", F.col("core").alias("whole"), "n", F.explode(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_join(F.filter(words, lambda w, j: j != i), " "))).alias("core"))
    longer = fewer.groupBy("root", "core").agg(F.max("n").alias("top"), F.max_by("whole", "n").alias("whole"))
    ties = fewer.join(_big(longer.select("root", "core", "top")), ["root", "core"]).where("n = top").groupBy("root", "core").agg(F.countDistinct("whole").alias("equals"))
    longer = longer.join(_big(ties), ["root", "core"]).where("equals = 1").select("root", "core", "top", "whole")
    links = full.join(_big(longer), ["root", "core"]).where(log("top") + DROPPED > log("n")).select(F.struct("root", "core").alias("a"), F.struct("root", F.col("whole").alias("core")).alias("b"))
    ends = settled(links).select("a.root", "a.core", F.col("b.core").alias("meant"))
    known = written(full.join(_big(ends), ["root", "core"], "left").select("root", "core", "n", F.coalesce("meant", "core").alias("meant")))

    of = known.groupBy("root", "meant").agg(F.sum("n").alias("n"))
    letters = of.select("root", "meant", "n", F.explode(F.array_distinct(F.transform(F.split("meant", " "), lambda w: F.substring(w, 1, 1)))).alias("letter"))
    letters = letters.groupBy("root", "letter", "n").agg(F.count(F.lit(1)).alias("equals"), F.min("meant").alias("meant")).groupBy("root", "letter").agg(F.max(F.struct("n", "equals", "meant")).alias("x"))
    letters = letters.where("x.equals = 1").select("root", "letter", F.col("x.n").alias("c"), "x.meant")
    short = rooted.where("core = ''")
    each = short.where("size(initials) > 0").select("spelling", "root", F.col("initials")[0].alias("first"), F.posexplode("initials").alias("place", "letter"))
    scored = each.join(_big(letters), ["root", "letter"], "left").groupBy("spelling").agg(F.first("first").alias("first"), F.max(F.when(F.col("meant").isNotNull(), F.struct((log("c") + F.when(F.col("place") > 0, LATER_INITIAL).otherwise(0.0)).alias("p"), (-F.col("place")).alias("o"), "meant"))).alias("x"))
    lettered = scored.select("spelling", F.coalesce("x.meant", "first").alias("meant"))
    alone = of.groupBy("root").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by("meant", "n").alias("meant")).where(F.col("top") >= SURE * F.col("all")).select("root", "meant")
    bare = short.where("size(initials) = 0").select("spelling", "root").join(_big(alone), "root", "left").select("spelling", F.coalesce("meant", F.lit("")).alias("meant"))
    whole = rooted.where("core <> ''").select("spelling", "root", "core").join(_big(known.select("root", "core", "meant")), ["root", "core"]).select("spelling", "meant")
    return whole.unionByName(lettered).unionByName(bare)


def names_of(entities: DataFrame, triples: DataFrame, types: tuple[str, ...] = ("Organization", "ThreatActor")) -> DataFrame:
    """name and n of the distinct strings in canonical_name, aliases and subject of those types."""
    nodes = entities.where(F.col("entity_type").isin(*types))
    stacked = nodes.select(F.col("canonical_name").alias("name")).unionByName(nodes.select(F.explode("aliases").alias("name"))).unionByName(
        triples.where(F.col("subject_type").isin(*types)).select(F.col("subject").alias("name")))
    return stacked.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def same_names(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """name_1, name_2: each pair of names that mean the same, the smaller first in byte order."""
    meant = written(entities_of(names_of(entities, triples)))
    a, b = meant.select(F.col("name").alias("name_1"), "entity"), meant.select(F.col("name").alias("name_2"), "entity")
    return a.join(_big(b), "entity").where("name_1 < name_2").select("name_1", "name_2")
