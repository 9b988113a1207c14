"""Scores of extracted triples against gold ones: by level, by entity type, by document, by stored
judgements and entailments.

Whatever depends on the order of triples runs in Python for each document; all else is joins by
document and aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions.columns import mapped
from spindrift.functions.names import for_match, names_match, token_set
from spindrift.operators.grouped import by_group
from spindrift.operators.matching import FEW, Golds, Near, prf, soft, taken
from spindrift.sources import responses

#: Share of the shorter name's words that the longer one must have at the levels below.
SHARE = 0.6
LEVELS = ["entity", "entity_name_only", "relation", "triple", "triple_compat", "triple_relaxed"]
_NARROW = {frozenset(p) for p in schema.COMPATIBLE}


def type_class(kind: Column) -> Column:
    """The class of a type: types of one class count as the same."""
    return mapped(kind, schema.TYPE_CLASSES, kind)


def forms(kg: DataFrame) -> DataFrame:
    """doc, seq, rel, the normal forms ns and no of both names and the classes cs and co of their types."""
    return kg.select("doc", "seq", "rel", for_match(F.col("s")).alias("ns"), for_match(F.col("o")).alias("no"), type_class(F.col("st")).alias("cs"), type_class(F.col("ot")).alias("co"))


class _Names:
    """Whether two names match, each pair looked at once."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], bool] = {}

    def __call__(self, a: str, b: str) -> bool:
        if (a, b) not in self.known:
            self.known[a, b] = soft(a, frozenset(a.split()), b, frozenset(b.split()), SHARE)
        return self.known[a, b]


def _tests(same: _Names) -> dict:
    def related(compat: bool):
        return lambda x, y: x == y or compat and frozenset((x, y)) in _NARROW

    def whole(compat: bool):
        rel = related(compat)
        forth = lambda p, g: (p[1], p[4]) == (g[1], g[4]) and same(p[0], g[0]) and same(p[3], g[3])
        back = lambda p, g: (p[1], p[4]) == (g[4], g[1]) and same(p[0], g[3]) and same(p[3], g[0])
        return lambda p, g: rel(p[2], g[2]) and (forth(p, g) or back(p, g))

    return {
        "entity": lambda p, g: p[1] == g[1] and same(p[0], g[0]), "entity_name_only": lambda p, g: same(p[0], g[0]),
        "relation": lambda p, g: p[1] == g[1] and (same(p[0], g[0]) and same(p[2], g[2]) or same(p[0], g[2]) and same(p[2], g[0])),
        "triple": whole(False), "triple_compat": whole(True), "triple_relaxed": lambda p, g: p[1] == g[1] and same(p[0], g[0]),
    }


def _looks() -> dict:
    """The tests as lookups, with the columns that hold names."""
    def whole(compat: bool):
        rel = lambda g, p: g.any_of(2, p[2], lambda a, b: a == b or compat and frozenset((a, b)) in _NARROW)
        forth = lambda g, p: g.equal(1, p[1]) & g.equal(4, p[4]) & g.near(0, p[0]) & g.near(3, p[3])
        back = lambda g, p: g.equal(4, p[1]) & g.equal(1, p[4]) & g.near(3, p[0]) & g.near(0, p[3])
        return lambda g, p: rel(g, p) & (forth(g, p) | back(g, p)), (0, 3)

    first: tuple = (lambda g, p: g.equal(1, p[1]) & g.near(0, p[0]), (0,))
    return {
        "entity": first, "entity_name_only": (lambda g, p: g.near(0, p[0]), (0,)),
        "relation": (lambda g, p: g.equal(1, p[1]) & (g.near(0, p[0]) & g.near(2, p[2]) | g.near(2, p[0]) & g.near(0, p[2])), (0, 2)),
        "triple": whole(False), "triple_compat": whole(True), "triple_relaxed": first,
    }


def _keys(level: str, rows: set[tuple]) -> set[tuple]:
    """The distinct keys of one side of a document, of its rows (ns, cs, rel, no, co)."""
    if level.startswith("entity"):
        ends = [x for ns, cs, _, no, co in rows for x in ((ns, cs), (no, co))]
        return {e if level == "entity" else e[:1] for e in ends}
    if level == "relation":
        return {(ns, rel, no) for ns, _, rel, no, _ in rows}
    return {(r[0], r[3]) for r in rows} if level == "triple_relaxed" else rows


def level_counts(pred: set[tuple], gold: set[tuple]) -> list[tuple]:
    """level, tp, n_pred, n_gold of the rows (ns, cs, rel, no, co) of a document."""
    out, tests, near = [], _tests(_Names()), None
    for level in LEVELS:
        p, g = _keys(level, pred), _keys(level, gold)
        tp, asked, free = len(p & g), sorted(p - g), sorted(g - p)
        if len(asked) * len(free) > FEW:
            near = near or Near((n for r in gold for n in (r[0], r[3])), lambda n: frozenset(n.split()), SHARE)
            look, named = _looks()[level]
            tp += len(asked) - len(taken(asked, free, look, near, named)[0])
        else:
            for key in asked:
                hit = next((i for i, x in enumerate(free) if tests[level](key, x)), None)
                if hit is not None:
                    del free[hit]
                    tp += 1
        out.append((level, tp, len(p), len(g)))
    return out


def levels_by_document(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """doc, level, tp, n_pred, n_gold (distinct keys) at six levels; ``pred`` and ``gold`` are ``forms``.

    entity (name and class of type), entity_name_only, relation (both names and the relation, either
    way round), triple (with the classes of the types), triple_compat (with compatible relations) and
    triple_relaxed (subject alike, object equal). Equal keys match first; then each key left, in byte
    order, takes the first free one that it matches. Rows without a document match nothing and are
    left out.
    """

    def run(doc: str, rows: Iterator[tuple]) -> list[tuple]:
        sides: tuple[set, set] = (set(), set())
        for r in rows:
            sides[r[6]].add(r[1:6])
        return [(doc, *c) for c in level_counts(*sides)]

    both = pred.withColumn("is_gold", F.lit(False)).unionByName(gold.withColumn("is_gold", F.lit(True))).where("doc is not null")
    return by_group(both.select("doc", "ns", "cs", "rel", "no", "co", "is_gold"), "doc", [], run, {"doc": "string", "level": "string", "tp": "long", "n_pred": "long", "n_gold": "long"})


def extraction_metrics(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """level, tp, fp, fn, precision, recall and f1, summed over documents."""
    sums = levels_by_document(forms(pred), forms(gold)).groupBy("level").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold")])
    return sums.select("level", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"), *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def _typed(rows: DataFrame) -> DataFrame:
    """doc, name, its first place and the class of its last type."""
    ends = forms(rows).where("doc is not null").select("doc", F.explode(F.array(*[F.struct((F.col("seq") * 2 + i).alias("at"), F.col(n).alias("name"), F.col(c).alias("class")) for i, n, c in ((0, "ns", "cs"), (1, "no", "co"))])).alias("e"))
    return ends.groupBy("doc", "e.name").agg(F.min("e.at").alias("at"), F.max_by("e.class", "e.at").alias("class")).withColumn("ws", token_set(F.col("name"), True))


def entity_type_f1(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """matched, correct, accuracy, and micro precision, recall and f1 of the types of names.

    Each name of ``pred`` takes the first name of its document's ``gold`` that it matches, which
    several may take. A pair counts once as right, or as wrong for both classes; names of either
    side that match none are wrong for their class.
    """
    p, g = _typed(pred).alias("p"), _typed(gold).alias("g")
    test = (F.col("p.doc") == F.col("g.doc")) & names_match(F.col("p.name"), F.col("g.name"), F.col("p.ws"), F.col("g.ws"), 0.5)
    took = p.join(g, test, "left").groupBy("p.doc", "p.name").agg(F.first("p.class").alias("class"), F.min_by("g.class", "g.at").alias("meant"))
    sums = took.agg(F.count_if(F.col("meant").isNotNull()).alias("matched"), F.count_if(F.col("meant") == F.col("class")).alias("correct"), F.count(F.lit(1)).alias("n"))
    missed = g.join(p, test, "left_anti").agg(F.count(F.lit(1)).alias("missed"))
    both = sums.crossJoin(F.broadcast(missed))
    tp = F.col("correct")
    return both.select("matched", "correct", F.round(F.when(F.col("matched") > 0, tp / F.col("matched")).otherwise(0.0), 4).alias("accuracy"), *prf(tp, F.col("n"), F.col("matched") + F.col("missed")))


def document_scores(by_document: DataFrame) -> DataFrame:
    """doc, tp, n_pred, n_gold, precision, recall, f1 of each document."""
    return by_document.where("doc is not null").select("doc", "tp", "n_pred", "n_gold", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def document_winners(scores: DataFrame, margin: float = 0.01) -> DataFrame:
    """winner and documents: of each document the system (doc, system, f1) that alone comes within
    ``margin`` of the best, if that is above 0, else ``tie``."""
    best = scores.groupBy("doc").agg(F.max("f1").alias("best"))
    near = scores.join(best, "doc").groupBy("doc").agg(F.max("best").alias("best"), F.count_if(F.col("f1") >= F.col("best") - margin).alias("near"), F.max_by("system", "f1").alias("first"))
    return near.groupBy(F.when((F.col("near") == 1) & (F.col("best") > 0), F.col("first")).otherwise("tie").alias("winner")).agg(F.count(F.lit(1)).alias("documents"))


# Stored answers of a judge


def payloads(pred: DataFrame, gold: DataFrame, articles: DataFrame, prompts: tuple[str, str]) -> DataFrame:
    """doc, n_pred, n_gold and the two prompts (precision, recall) of each document of ``gold``.

    ``pred`` and ``gold`` have doc, seq, s, rel, o. Edges are listed as JSON with their numbers, gold
    entities by first appearance; ``articles`` (doc, text) give the context. The edges of a document
    are few.
    """
    def listed(rows: DataFrame, prefix: str, name: str) -> DataFrame:
        own = rows.where("doc is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "s", "rel", "o"))).alias("l"))
        return own.select("doc", F.transform("l", lambda e, i: F.struct(F.concat(F.lit(prefix + "_"), i).alias("index"), e["s"].alias("sub"), e["rel"].alias("rel"), e["o"].alias("obj"))).alias(name))

    both = listed(gold, "truth_relationship", "g").join(listed(pred, "predict_relationship", "p"), "doc", "left").join(articles.select("doc", F.col("text").alias("article")), "doc", "left")
    names = F.array_distinct(F.filter(F.flatten(F.transform("g", lambda e: F.array(e["sub"], e["obj"]))), lambda n: n != ""))
    none = F.array().cast("array<struct<index:string,sub:string,rel:string,obj:string>>")
    parts = both.select("doc", F.coalesce("p", none).alias("p"), "g", F.to_json(F.transform(names, lambda n: F.struct(n.alias("name")))).alias("names"), F.coalesce(F.nullif("article", F.lit("")), F.lit("N/A")).alias("article"))
    titles = ("Prediction Relations", "Ground Truth Reference Entities", "Ground Truth Reference Relations", "Article")
    bodies = (F.to_json("p"), F.col("names"), F.to_json("g"), F.col("article"))

    def prompt(text: str, order: tuple[int, ...]) -> Column:
        return F.concat(F.lit(text), *[x for i in order for x in (F.lit(f"\n--- {titles[i]} ---\n"), bodies[i], F.lit("\n"))])

    return parts.select("doc", F.size("p").alias("n_pred"), F.size("g").alias("n_gold"), prompt(prompts[0], (0, 1, 2, 3)).alias("precision_prompt"), prompt(prompts[1], (1, 2, 0, 3)).alias("recall_prompt"))


def judge_f1(asked: DataFrame, answers: DataFrame, model: str) -> DataFrame:
    """precision_tp, recall_tp, n_pred, n_gold, precision, recall, f1 from stored answers (key, response).

    ``asked`` are ``payloads``. Shares are of all edges, judged or not; documents without an answer,
    or with an unreadable one, have no true positives.
    """
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"{k}_prompt").alias("prompt")) for k in ("precision", "recall")])
    rows = asked.select("doc", "n_pred", "n_gold", F.lit(model).alias("model"), F.explode(sides).alias("x")).select("doc", "n_pred", "n_gold", "model", "x.side", "x.prompt")
    judged = responses.replayed(rows, answers).select("side", "n_pred", "n_gold", responses.verdicts(F.coalesce("response", F.lit("")))["tp"].alias("tp"))
    first = F.col("side") == "precision"
    sums = judged.agg(*[F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).alias(n) for c, x, n in ((first, "tp", "precision_tp"), (~first, "tp", "recall_tp"), (first, "n_pred", "n_pred"), (first, "n_gold", "n_gold"))])
    p, r = (F.when(F.col(n) > 0, F.col(t) / F.col(n)).otherwise(0.0) for t, n in (("precision_tp", "n_pred"), ("recall_tp", "n_gold")))
    return sums.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))


# Stored scores of an entailment model


def entailed(pred: DataFrame, gold: DataFrame, scores: DataFrame, model: str, least: float = 0.5) -> DataFrame:
    """seq of ``pred``, top (the highest stored probability that an edge of its document's ``gold``
    entails it, null if none is stored) and covered (whether that reaches ``least``).

    ``scores`` has key and probability, one row a key. Every pair of a document is looked up.
    """
    said = lambda df, name: df.where("doc is not null").select("doc", "seq", responses.verbalize(F.col("s"), F.col("rel"), F.col("o")).alias(name))
    pairs = said(pred, "hypothesis").join(said(gold, "premise").select("doc", "premise").distinct(), "doc")
    keyed = pairs.select("seq", responses.pair_key(F.lit(model), F.col("premise"), F.col("hypothesis")).alias("key"))
    top = keyed.join(scores.select("key", "probability"), "key").groupBy("seq").agg(F.max("probability").alias("top"))
    return pred.select("seq").join(top, "seq", "left").select("seq", "top", F.coalesce(F.col("top") >= least, F.lit(False)).alias("covered"))


def canonicalization(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, n_pred, n_gold, precision, recall, f1 of node ids (one row a node), and how many nodes
    ``gold`` has fewer, with its share in per cent."""
    both = pred.select("node_id", F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select("node_id", F.lit(0).alias("p"), F.lit(1).alias("g"))).groupBy("node_id").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    sums = both.agg(F.coalesce(F.sum(F.col("p") * F.col("g")), F.lit(0)).alias("tp"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_gold"))
    return sums.select("tp", "n_pred", "n_gold", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")), (F.col("n_pred") - F.col("n_gold")).alias("reduction"), F.round(F.when(F.col("n_pred") > 0, 100 * (F.col("n_pred") - F.col("n_gold")) / F.col("n_pred")).otherwise(0.0), 2).alias("reduction_percent"))
