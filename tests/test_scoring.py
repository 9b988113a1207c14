"""Scores, extraction and grounding: literal cases and edges."""

import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift import pipeline
from spindrift.operators import extract, ground, matching, pairs, quality, scoring
from spindrift.plans import extraction, fusion
from tests_kg import kg


def level(df, name):
    return next((r.tp, r.fp, r.fn) for r in df.collect() if r.level == name)


def test_levels(spark):
    gold = kg(spark, {"s": "The Fox", "rel": "uses", "o": "Nmap"}, {"s": "Owl", "st": "ThreatActor", "rel": "targets", "o": "Acme Corp", "ot": "Organization"}, {"doc": None})
    pred = kg(spark, {"s": "fox", "st": "Software", "rel": "uses", "o": "nmap"}, {"s": "Acme", "st": "Organization", "rel": "exploits", "o": "owl", "ot": "ThreatActor"}, {"doc": "e"})
    got = scoring.extraction_metrics(pred, gold)
    assert level(got, "entity") == (4, 2, 0) and level(got, "entity_name_only") == (4, 2, 0)
    assert level(got, "relation") == (1, 2, 1) and level(got, "triple") == (1, 2, 1)
    assert level(got, "triple_compat") == (2, 1, 0)  # turned round, exploits beside targets
    assert level(got, "triple_relaxed") == (1, 2, 1)
    assert scoring.extraction_metrics(pred.where("false"), gold.where("false")).count() == 0


def test_entity_types(spark):
    gold = kg(spark, {"s": "Fox", "st": "Tool", "o": "Elm", "ot": "Location"}, {"s": "Yew", "st": "File", "o": "Elm", "ot": "Organization"})
    pred = kg(spark, {"s": "the fox", "st": "Malware", "o": "Elm", "ot": "Location"}, {"s": "Ash", "st": "File", "o": "Oak", "ot": "File"})
    row = scoring.entity_type_f1(pred, gold).first()
    assert (row.matched, row.correct, row.accuracy, row.precision, row.recall) == (2, 1, 0.5, 0.25, 0.3333)


def test_swapped_and_strict():
    e = lambda s, r, o: (s, frozenset(s.split()), r, o, frozenset(o.split()))
    p, g = [e("b", "x", "a"), e("a", "x", "b")], [e("a", "y", "b"), e("b", "z", "a")]
    assert matching.greedy(p, g, matching.PASSES["swapped"]) == 2
    assert matching.greedy(p, g, matching.PASSES["strict"]) == 0
    assert matching.greedy(p[:1], g[:1], matching.PASSES["swapped"]) == 1


def test_long_paths_of_matching():
    n = 3000
    assert matching.largest_matching([[i, i + 1] for i in range(n)][::-1] + [[0]]) == n + 1
    assert matching.largest_matching([]) == 0


def test_embed_matches(spark):
    v = lambda *rows: spark.createDataFrame(rows, "item long, id long, v array<double>")
    pred, gold = v((1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (2, 3, [1.0, 0.0])), v((1, 7, [1.0, 0.0]), (3, 9, [1.0, 0.0]))
    assert {(r.p, r.covered) for r in matching.embed_covered(pred, gold, 0.9).collect()} == {(1, True), (2, True), (3, False)}
    assert {tuple(r) for r in matching.embed_matches(pred, gold, 0.9).collect()} == {(1, 1, 2, 1), (2, 0, 1, 0), (3, 0, 0, 1)}


def test_judge_edges(spark):
    pred, gold = kg(spark, {"o": "A"}, {"o": "B"}, {"doc": "other"}), kg(spark, {"o": "A"}, {"doc": "e"})
    articles = spark.createDataFrame([("d", "text")], "doc string, text string")
    asked = scoring.payloads(pred, gold, articles, ("P", "R")).orderBy("doc").collect()
    assert [(r.doc, r.n_pred, r.n_gold) for r in asked] == [("d", 2, 1), ("e", 0, 1)]
    assert '"index":"predict_relationship_1"' in asked[0].precision_prompt and "text" in asked[0].recall_prompt and "N/A" in asked[1].recall_prompt
    none = spark.createDataFrame([], "key string, response string")
    row = scoring.judge_f1(scoring.payloads(pred, gold, articles, ("P", "R")), none, "m").first()
    assert (row.precision_tp, row.n_pred, row.n_gold, row.f1) == (0, 2, 2, 0.0)


def test_entailed_edges(spark):
    pred, gold = kg(spark, {}, {"doc": "e"}, {"s": "Owl"}), kg(spark, {"o": "Nmap 7"})
    from spindrift.sources.responses import pair_key

    said = spark.createDataFrame([("Fox uses Nmap 7.", "Fox uses Nmap.", 0.5), ("Fox uses Nmap 7.", "Owl uses Nmap.", 0.4)], "p string, h string, probability double")
    scores = said.select(pair_key(F.lit("m"), F.col("p"), F.col("h")).alias("key"), "probability")
    assert {tuple(r) for r in scoring.entailed(pred, gold, scores, "m").collect()} == {(0, 0.5, True), (1, None, False), (2, 0.4, False)}


def test_winners(spark):
    rows = [("d", "a", 0.5), ("d", "b", 0.495), ("e", "a", 0.5), ("e", "b", 0.4), ("f", "a", 0.0), ("g", "b", 0.1)]
    got = scoring.document_winners(spark.createDataFrame(rows, "doc string, system string, f1 double"))
    assert {tuple(r) for r in got.collect()} == {("tie", 2), ("a", 1), ("b", 1)}


def test_taxonomy_by_run(spark):
    rows = [("r1", "hosted", "type_misassignment", "flagged"), ("r1", "hosted", "self_loop", "rejected"), ("r2", "hosted", "self_loop", "rejected")]
    got = {r.run: r for r in quality.taxonomy_by_run(spark.createDataFrame(rows, "run string, serving string, category string, action string"), k=1).collect()}
    assert (got["r1"].n, got["r1"].rejected, got["r1"].disputed, got["r1"].serving_mean, got["r1"].top) == (2, 0.5, 0.5, 0.25, "self_loop=0.500")


# extraction


def answers(spark, *rows):
    return spark.createDataFrame(rows, "chunk_id string, response string, text string")


def test_extracted(spark):
    t = lambda **k: {"subject": "Fox", "subject_type": "Malware", "relation": "uses", "object": "Nmap", "object_type": "Tool"} | k
    triples = [
        t(subject="the Acme", subject_type="Organization", relation="attacked by", object="Fox", object_type="malware"), t(relation="deployed-by", object="Owl", object_type="ThreatActor"), t(object="Nmap, Zed and Psexec"),
        t(relation="related to", object="2021", object_type="Other"), t(object=None), t(subject="it"), t(relation="operated by", object="Elm", object_type="Organization", evidence="given"), t(relation=None, object="as usual", object_type="Other"),
    ]
    df = answers(spark, ("c", json.dumps({"triples": triples}), "Intro. Fox hits Acme! Nothing else."), ("n", None, None), ("b", "broken", None))
    rows = extract.extracted(df).orderBy("i", "part").collect()
    assert [(r.i, r.part, r.s, r.rel, r.o) for r in rows] == [
        (0, 0, "Fox", "targets", "Acme"), (1, 0, "Owl", "uses", "Fox"), (2, 0, "Fox", "uses", "Nmap"), (2, 1, "Fox", "uses", "Zed"), (2, 2, "Fox", "uses", "Psexec"),
        (5, 0, "Nmap", "uses", "Nmap"), (6, 0, "Fox", "attributed_to", "Elm")]
    assert rows[0].ev == "Fox hits Acme!" and rows[6].ev == "given" and rows[0].event_id == "c_t0" and {r.conf for r in rows} == {1.0}
    assert extract.extracted(df, 2).count() == 2
    assert extract.extracted(df.where("false")).count() == 0


@pytest.mark.parametrize(("rel", "obj", "kind", "want"), [("related_to", "May 2021", "Other", True), ("uses", "2021", "Other", False), ("targets", "sectors", "Organization", True), ("drops", "to disk", "File", True), ("variant_of", "RAT", "Other", True), ("variant_of", "rat", "Malware", False), ("associated_with", "$1.5 million", "Other", True), ("targets", "12 victims", "Other", True), ("uses", " ", "Tool", True)])
def test_says_little(spark, rel, obj, kind, want):
    assert spark.range(1).select(extract.says_little(F.lit(rel), F.lit(obj), F.lit(kind)).alias("x")).first().x is want


def test_passes_and_guided(spark):
    known, found = kg(spark, {"conf": 1.0}, {"s": "Gone", "status": "rejected"}), kg(spark, {"s": "nmap", "o": "fox"}, {"s": "New", "conf": 0.95}, {"s": "Gone"})
    assert sorted((r.s, r.conf) for r in extract.with_pass(known, found, 0.9).collect()) == [("Fox", 1.0), ("Gone", 0.9), ("New", 0.9)]
    assert sorted((r.s, r.conf) for r in extract.guided(known, found).collect()) == [("Gone", 0.75), ("New", 0.75)]


def test_links(spark):
    rows = kg(spark, {"s": "A", "o": "B"}, {"s": "A", "o": "C"}, {"s": "X::Y", "o": "Z"})
    asked = extract.link_requests(rows).collect()
    assert [(r.type_a, r.name_a, r.type_b, r.name_b) for r in asked] == [("Malware", "A", "Malware", "X::Y")]
    said = spark.createDataFrame([("d", n, "A", "X", r) for n, r in enumerate(['{"subject": "a", "object": "Q", "relation": "uses", "subject_type": "Nope"}', '{"skip": true}', 'so: {"subject": "M", "object": "N"}', None, "none", '[1]'])], "doc string, n int, name_a string, name_b string, response string")
    assert [(r.n, r.s, r.st, r.rel, r.o, r.conf) for r in extract.predicted_links(said).collect()] == [(0, "a", "Other", "uses", "Q", 0.7)]


# grounding


MITRE = "rec_id long, type string, object_type string, mitre_id string, name string, title string, aliases array<string>, external_references array<struct<source_name:string,external_id:string>>, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, contents string"


def catalogue(spark, *rows):
    names = [c.split()[0] for c in ("rec_id", "type", "object_type", "mitre_id", "name", "title", "aliases", "external_references", "kill_chain_phases", "contents")]
    return spark.createDataFrame([tuple({"rec_id": i} .get(n, r.get(n)) for n in names) for i, r in enumerate(rows)], MITRE)


def test_nested_contents(spark):
    m = catalogue(
        spark, {"type": "tool", "contents": json.dumps({"name": "Mimikatz", "x_mitre_aliases": ["mimikatz.exe", "kiwi", None]})},
        {"mitre_id": "T1059", "title": "Command and Scripting Interpreter", "contents": json.dumps({"name": "Command and Scripting Interpreter", "description": "d" * 300, "kill_chain_phases": [None, "x", {"kill_chain_name": "mitre-attack", "phase_name": "execution"}]})},
        {"type": "attack-pattern", "name": "Inner", "contents": json.dumps({"external_references": {"source_name": "mitre-attack", "external_id": "T9"}})}, {"type": "tool", "contents": "{"}, {"type": "tool", "contents": json.dumps(json.dumps({"name": "Twice"}))},
        {"type": "malware", "name": "Own", "aliases": [None], "contents": json.dumps({"name": "Other", "aliases": "text"})}, {"type": "intrusion-set", "object_type": "tool", "name": "APT29", "aliases": ["Cozy Bear", "The Dukes"]})
    aliases = {(r.kind, r.alias): r.canonical for r in ground.alias_table(m).collect()}
    assert aliases == {("software", "mimikatz"): "Mimikatz", ("software", "mimikatz.exe"): "Mimikatz", ("software", "kiwi"): "Mimikatz", ("software", "own"): "Own", ("group", "apt29"): "APT29", ("group", "cozy bear"): "APT29", ("group", "the dukes"): "APT29"}
    assert {r.canonical: r.aliases for r in ground.known_aliases(ground.alias_table(m), "group").collect()} == {"APT29": ["cozy bear", "the dukes"]}
    found = {r.technique_id: r for r in ground.technique_catalogue(m).collect()}
    assert found["T1059"].tactics == ["execution"] and len(found["T1059"].description) == 200 and found["T9"].name == "Inner"
    names = spark.createDataFrame([(x,) for x in ("Command & Scripting Interpreter", "command and scripting INTERPRETER ", "scripting command and", "nothing", "", None)], "name string")
    got = {r.name: (r.technique_id, r.score) for r in ground.ground_techniques(names, ground.technique_records(m)).collect()}
    assert got == {"Command & Scripting Interpreter": ("T1059", 0.75), "command and scripting INTERPRETER ": ("T1059", 1.0), "scripting command and": ("T1059", 0.75)}
    assert ground.alias_table(m.where("false")).count() == 0


def test_known_casing_and_first_spelling(spark):
    none = spark.createDataFrame([], "kind string, alias string, canonical string")
    rows = kg(spark, {"s": "lazarus", "st": "ThreatActor", "o": "coBalt  strike"}, {"s": "ZED", "o": "cobalt strike"}, {"s": "Zed", "o": "zed", "ot": "Malware"}, {"s": "zed", "status": "rejected"})
    got = {r.seq: (r.s, r.o) for r in ground.canonicalized(rows, none).collect()}
    assert got == {0: ("Lazarus Group", "Cobalt Strike"), 1: ("ZED", "Cobalt Strike"), 2: ("ZED", "ZED"), 3: ("zed", "Nmap")}


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_join_finds_all(spark, seed):
    """The join on the rarest words finds what comparing all pairs finds."""
    rng = random.Random(seed)
    some = lambda n: sorted({" ".join(rng.sample("the of red fox owl elm ash oak".split(), rng.randint(1, 6))) for _ in range(n)})
    asked, listed = some(60), some(40)
    m = catalogue(spark, *[{"type": "attack-pattern", "mitre_id": f"T{i}", "name": x} for i, x in enumerate(listed)])
    got = {r.name: (r.technique_id, r.score) for r in ground.ground_techniques(spark.createDataFrame([(x,) for x in asked], "name string"), ground.technique_records(m)).collect()}
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = {}
    for a in asked:
        best = max(((a == b, jac(a, b), -i) for i, b in enumerate(listed)))
        if best[1] >= 0.6:
            want[a] = (f"T{-best[2]}", round(best[1], 6))
    assert got == want


def test_ablation_scores(spark):
    rows = kg(spark, {}, {"s": "", "doc": "e"}, {"doc": "e"})
    gold = rows.where("s <> ''")
    got = {(r.arm, r.level): (r.tp, r.delta) for r in pipeline.ablation_scores(rows, gold, [pipeline.Steps(False, False, False), pipeline.Steps()]).collect()}
    assert got["none", "triple"] == (2, 0.0) and got["P+R+V", "triple"][0] == 2 and got["P+R+V", "triple"][1] > 0
    with pytest.raises(ValueError, match="no triples"):
        pipeline.ablation_scores(rows.where("doc = 'd'"), gold, [pipeline.Steps()])


def unnamed(spark, tmp_path, n):
    """A folder with a table of ``n`` triples of the chunk without a name, and DuckDB on it."""
    rng, kinds = random.Random(n), ["ThreatActor", "Malware", "Tool", "Organization", "Other"]
    name = lambda: rng.choice(["it", "the group", "Fox", "Owl and Elm", "a Yew, Ash and Oak", "2019", "", "ransomware"]) if rng.random() < 0.3 else f"Name{rng.randrange(n)}"
    rows = [(i, name(), rng.choice(kinds), rng.choice(["uses", "used by", "targets", "related_to"]), name(), rng.choice(kinds), "said", "", "", [], 0.9, rng.choice(["raw", "rejected", "validated"])) for i in range(n)]
    spark.createDataFrame(rows, "seq long, subject string, subject_type string, relation string, object string, object_type string, evidence_text string, source_doc_id string, source_chunk_id string, attack_ids array<string>, confidence double, validation_status string").coalesce(1).write.parquet(f"{tmp_path}/triples.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view triples as select * from '{tmp_path}/triples.parquet/*.parquet'")
    return str(tmp_path), duck


def same_as_sql(df, duck, sql):
    got = duck.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()
    assert Counter(tuple(r) for r in df.collect()) == Counter(got) and got


def test_first_triples_of_a_large_chunk(spark, tmp_path):
    """Places beyond 2,047 do not overflow, and several answers count as one chunk."""
    d, duck = unnamed(spark, tmp_path, 2100)
    same_as_sql(extraction.first_triples(spark, d), duck, extraction.SQL["first_triples"])
    whole = extraction.stored_answers(spark, d, 10**6)
    assert whole.count() == 1 and extract.extracted(whole).where("i > 2047").count() > 0


def test_guided_pairs_of_a_large_chunk(spark, tmp_path):
    """The pairs that SQL finds, while no plan joins a chunk with itself."""
    d, duck = unnamed(spark, tmp_path, 400)
    got = fusion.guided_pairs(spark, d)
    same_as_sql(got, duck, fusion.SQL["guided_pairs"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(20))
def test_first_pairs_equal_all_pairs(seed):
    rng = random.Random(seed)
    ents = [(i, n, n.lower(), rng.choice(["Malware", "Tool", "Other", "Location", "ThreatActor"])) for i, n in enumerate(rng.sample([c + d for c in "aAbB" for d in "xyzXYZ"], 15))]
    related = {tuple(sorted((rng.choice(ents)[2], rng.choice(ents)[2]))) for _ in range(60)}
    rows = [("c", 0, None, x, y, None) for x, y in related] + [("c", 1, *e) for e in ents]
    every = [(a, b, *pairs._FITTING[a[3], b[3]]) for i, a in enumerate(ents) for b in ents[i + 1 :] if (a[3], b[3]) in pairs._FITTING and tuple(sorted((a[2], b[2]))) not in related]
    for k in (1, 3, 8, 500):
        want = [(n, b[1], rel, a[1]) if turned else (n, a[1], rel, b[1]) for n, (a, b, rel, turned) in enumerate(every[:k], 1)]
        assert pairs.first_pairs(iter(rows), k) == want

WORDS = "fox owl elm ash oak group apt 28 29 bear of".split()


def some_name(rng):
    return rng.choice(["", "a", "apt28", "apt 2", "oa"]) if rng.random() < 0.1 else " ".join(rng.sample(WORDS, rng.randint(1, 4)))


def some_edge(rng):
    s, o = some_name(rng), some_name(rng)
    return s, frozenset(s.split()), rng.choice(["uses", "drops", "delivers", "targets", "related_to", "exploits"]), o, frozenset(o.split())


@pytest.mark.parametrize("matcher", ["triplet", "pair", "compat", "strict", "swapped", "rel_eq", "exact"])
@pytest.mark.parametrize("block", [7, 1 << 14])
def test_lookups_match_as_greedy_does(monkeypatch, matcher, block):
    """A large document's matches are looked up, block by block, and are those of comparing each pair."""
    one_by_one = matching.greedy
    for name, value in (("FEW", 0), ("BLOCK", block), ("greedy", None)):
        monkeypatch.setattr(matching, name, value)
    for seed in range(10):
        rng = random.Random(seed)
        p = [some_edge(rng) for _ in range(60)]
        g = [some_edge(rng) for _ in range(50)] + p[:5]
        assert matching.matched(p, g, matcher) == one_by_one(p, g, matching.PASSES[matcher]) > 0


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_levels_looked_up(monkeypatch, block):
    """The levels of a large document are looked up, block by block, and are those of comparing each pair."""
    monkeypatch.setattr(matching, "BLOCK", block)
    for seed in range(10):
        rng = random.Random(seed)
        p, g = ({(e[0], rng.choice("xyz"), e[2], e[3], rng.choice("xyz")) for e in (some_edge(rng) for _ in range(n))} for n in (60, 50))
        counts = []
        for few in (10**9, 0):
            monkeypatch.setattr(scoring, "FEW", few)
            counts.append(scoring.level_counts(p, g))
        assert counts[0] == counts[1] and all(tp > 0 for _, tp, _, _ in counts[0][:3])


def test_extracted_triples_of_a_large_chunk(spark, tmp_path):
    """Pronouns reach back over several answers of one chunk."""
    d, duck = unnamed(spark, tmp_path, 2060)
    assert extraction.stored_answers(spark, d).count() == 11
    same_as_sql(extraction.extracted_triples(spark, d), duck, extraction.SQL["extracted_triples"])


@pytest.mark.parametrize("matcher", ["compat", "strict", "pair", "swapped"])
def test_small_documents_looked_up(monkeypatch, matcher):
    """Matches of a small document are looked up too, and are those of comparing each pair."""
    one_by_one = matching.greedy
    monkeypatch.setattr(matching, "greedy", None)
    for seed in range(30):
        rng = random.Random(seed)
        p, g = [some_edge(rng) for _ in range(40)], [some_edge(rng) for _ in range(30)]
        assert matching.matched(p, g, matcher) == one_by_one(p, g, matching.PASSES[matcher]) > 0


def test_sided_as_keyed(spark):
    """One reading of the delivered triples has the forms, relations and words of the keyed graph."""
    from spindrift.plans.base import graph_triples

    rng = random.Random(3)
    part = lambda: rng.choice(["", " ", "\t", " ", "\x1c", "  ", "the ", "The a ", "THESE", "Foxes", "attackers", "boss", "Ärzte", "İx", "apt 28", "cves", "those", "an\nelm", "　"])
    name = lambda: None if rng.random() < 0.05 else "".join(part() for _ in range(rng.randint(1, 5)))
    said = lambda: rng.choice([None, "", "USES", " used\tby", "targets ", "is a", "IS A", "located_in", "Exploits", "runs on", "Known as", "communicates_with", "zz"])
    rows = [(i, rng.choice([None, "", "d"]), "c", name(), "Tool", said(), name(), "Tool", "", 0.5, rng.choice([None, "raw", " Repaired", "VALIDATED ", "validated", "rejected", "ok?"]), []) for i in range(400)]
    triples = spark.createDataFrame(rows, "seq long, source_doc_id string, source_chunk_id string, subject string, subject_type string, relation string, object string, object_type string, evidence_text string, confidence double, validation_status string, attack_ids array<string>")
    kept = graph_triples(triples).where("status <> 'rejected'")
    for stemmed in (True, False):
        want = matching.keyed(kept, stemmed).join(kept.select("seq", (F.col("status") == "validated").alias("is_gold")), "seq")
        got = matching.sided(triples, ["raw", "repaired"], ["validated"]).collect()
        assert sorted((r.seq, r.doc or "", r.ns, r.rel, r.no, r.is_gold, matching.words_of(r.ns, stemmed), matching.words_of(r.no, stemmed)) for r in got) == sorted((r.seq, r.doc or "", r.ns, r.rel, r.no, r.is_gold, frozenset(r.ts), frozenset(r.to)) for r in want.collect())


def test_relations_named_outside_the_jvm(spark):
    """``strict_f1`` reads the keys of relations in the JVM and names each once; the names are those of the columns."""
    from spindrift import schema
    from spindrift.functions.relations import relation_named, relation_of
    from spindrift.plans import scoring as plans

    said = sorted({*schema.RELATIONS, *(w for ws in schema.RELATION_WORDINGS.values() for w in ws), *(f"x{w} y" for _, ws in schema.RELATION_STEMS for w in ws), "", " ", "zz", "uses\nno", "ärgert"})
    got = spark.createDataFrame([(w,) for w in said], "key string").select("key", relation_of(F.col("key")).alias("rel")).collect()
    assert {r.key: r.rel for r in got} == {w: relation_named(w) for w in said}
    plan = plans.QUERIES["strict_f1"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "relation#" in plan and "lambda" not in plan and "communicates_with" not in plan
    rows = [(i, "d", f"Name{i // 2}", r, "Elm", ("raw", "validated")[i % 2]) for i, r in enumerate(["Exploited by", "exploits", " TARGETS", "targeting", "uses", "zz"])]
    triples = spark.createDataFrame(rows, "seq long, source_doc_id string, subject string, relation string, object string, validation_status string")
    both = [matching.greedy_by_document(matching.sided(triples, ["raw"], ["validated"], named=n), "strict", False, named=n).collect() for n in (True, False)]
    assert both[0] == both[1] and both[0][0].tp == 2


def test_names_of_a_document_compared_by_words():
    """A name of a small document is compared with few of the gold names, not with each."""
    asked = []

    class Name(str):
        def __contains__(self, other):
            asked.append(other)
            return super().__contains__(other)

    def edge(s, o):
        return Name(s), frozenset(s.split()), "uses", Name(o), frozenset(o.split())

    golds = [edge(f"gold{i}x", f"both{i}x") for i in range(60)]
    preds = [edge(f"pred{i}x elm{i}", f"both{i}x") for i in range(60)] + [edge("gold5x owl", "both5x")]
    assert matching.matched(preds, golds, "pair") == 1
    assert len(asked) < 1000


def test_lookup_inside_long_names():
    """Names that lie in a long one are found by their first letters, not by each part of it."""
    near = matching.Near([f"{'x' * (n % 97)}{n} elm" for n in range(9000)] + ["", "a", "ab", "elm", "owl"], lambda n: frozenset(n.split()), 0.5)
    looked = []
    near.place = type("Places", (dict,), {"get": lambda self, x: looked.append(x) or dict.get(self, x)})(near.place)
    name = "owl " * 30 + "zab" + "elm"
    assert sorted(near.names[i] for i in near.inside(name)) == sorted(n for n in near.names if n in name or name in n) == ["", "a", "ab", "elm", "owl"]
    assert len(looked) < 1000


@pytest.mark.parametrize("query", ["greedy_f1_pair", "swapped_pair_f1"])
def test_matchers_without_relations_read_none(spark, query):
    from spindrift.plans import quality as other
    from spindrift.plans import scoring as plans

    plan = (other.QUERIES | plans.QUERIES)[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1:]
    assert read and not any("relation:" in x for x in read) and any("subject:" in x for x in read)


def test_values_as_pylist():
    import pyarrow as pa

    from spindrift.operators.grouped import values

    for column in (pa.array(["a", None, "ä"]), pa.array([], pa.string()), pa.array([1, 2**60]), pa.array([1, None]), pa.array([True, False]), pa.array([None, True]), pa.array([None, None], pa.string()), pa.array([["x"], None])):
        assert values(column) == column.to_pylist() and [type(x) for x in values(column)] == [type(x) for x in column.to_pylist()]
