"""Edge cases of the core's operators: nulls, empty tables, ties, repeats, clashing columns."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift import pipeline
from spindrift.operators import fuse, graphs, matching, nested, pairs, retrieve, salience, segment, skew, validate
from spindrift.plans.base import graph_triples
from tests_kg import kg

def test_graph_triples_nulls(spark):
    schema = "seq long, subject string, subject_type string, relation string, object string, object_type string, evidence_text string, source_doc_id string, source_chunk_id string, attack_ids array<string>, confidence double, validation_status string, s int"
    row = graph_triples(spark.createDataFrame([(1, *[None] * 12), (2, *[None] * 9, float("nan"), "x", 3)], schema)).orderBy("seq").collect()
    assert [(r.s, r.st, r.rel, r.conf, r.status, r.aids) for r in row] == [("", "Other", "related_to", 1.0, "raw", [])] * 2


def test_validator(spark):
    rows = validate.validate(kg(
        spark, {}, {"s": ""}, {"rel": "located_in", "st": "Location", "s": "Rome", "o": "Fox", "ot": "Malware", "ev": "Fox is in Rome"}, {"rel": "located_in"},
        {"o": "fox", "ot": "Malware", "rel": "variant_of"}, {"ev": ""}, {"o": "cve 2024-1234", "ot": "Vulnerability", "ev": "Fox cve 2024 1234"}, {"ev": "nothing here", "conf": 0.2}, {"aids": ["T1", "T1059"]},
    ), validate.Policy(least_confidence=0.15)).orderBy("seq").collect()
    assert [r.status for r in rows] == ["validated", "rejected", "repaired", "rejected", "rejected", "validated", "repaired", "rejected", "validated"]
    assert [r.reason for r in rows if r.reason] == ["empty_field", "impossible_type_pair", "self_loop", "confidence_lowered"]
    assert (rows[2].s, rows[2].o) == ("Fox", "Rome") and rows[6].o == "CVE-2024-1234" and rows[8].aids == ["T1059"] and abs(rows[5].conf - 0.7) < 1e-9


def test_empty_tables(spark):
    none = kg(spark, {}).where("false")
    for df in (validate.keep_best(validate.validate(none)), salience.most_salient(none), fuse.entity_map(none), fuse.fuse_edges(none), pairs.guided_pairs(none), pairs.resolve_pronouns(none), graphs.main_nodes(none)):
        assert df.count() == 0


def test_keep_best_ties(spark):
    df = validate.keep_best(kg(spark, {}, {}, {"s": "fox", "conf": 0.95}, {"status": "rejected"}, {"status": "rejected"}, {"doc": None}))
    assert sorted(r.seq for r in df.collect()) == [2, 3, 4, 5]


def test_additions_are_swap_aware(spark):
    old = kg(spark, {"s": "A", "o": "B"})
    new = kg(spark, {"s": "b", "o": "a"}, {"s": "C", "o": "D"}, {"s": "c", "o": "d"}, {"s": "D", "o": "C"})
    assert sorted(r.seq for r in pairs.additions(old, new).collect()) == [1, 3]


def test_pronouns(spark):
    df = pairs.resolve_pronouns(kg(spark, {"s": "It", "st": "Malware"}, {"s": "Fox"}, {"s": "it", "st": "Malware", "o": "They", "ot": "ThreatActor"}, {"s": "Owl", "st": "ThreatActor"}, {"s": "they", "st": "ThreatActor"}, {"s": "it", "chunk": "other", "o": "x", "ot": "Other"}))
    assert [r.s for r in df.orderBy("seq").collect()] == ["Nmap", "Fox", "Nmap", "Owl", "Owl", "it"]


def test_fused_confidence(spark):
    row = fuse.fuse_edges(kg(spark, {"conf": 0.6}, {"s": "FOX", "doc": "e", "conf": 0.9}, {"doc": "f", "conf": 0.9})).first()
    assert (row.seq, row.rows, row.docs, row.conf) == (1, 3, 3, 1.0)


def test_duplicate_candidates(spark):
    df = spark.createDataFrame([("a", "T", "The Fox", None), ("b", "T", "fox.", []), ("c", "T", "foxglove", ["Q"]), ("d", "T", "zebra", ["q"]), ("e", "U", "fox", None), ("f", "T", None, None), ("g", "T", "digitalis foxglove", [])], "node_id string, entity_type string, canonical_name string, aliases array<string>")
    assert {tuple(r) for r in pairs.duplicate_candidates(df).collect()} == {("a", "b", "name"), ("c", "d", "alias"), ("c", "g", "substring")}


def test_hot_keys_and_lookup(spark):
    rows = spark.createDataFrame([(i, "h") for i in range(60)] + [(i, "b") for i in range(60, 69)] + [(80, "a"), (81, None), (82, None), (84, "zz")], "i int, k string")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.hot_keys(counts, "k", most=8)
    assert {(r.k, r.parts) for r in hot.collect()} == {("h", 8), ("b", 2)}
    entries = spark.createDataFrame([("h", 10), ("a", 20), ("b", 30)], "k string, v int")
    found = skew.lookup(rows, entries, "k", hot, ["i"])
    assert sorted((r.i, r.v) for r in found.collect()) == [(i, 10) for i in range(60)] + [(i, 30) for i in range(60, 69)] + [(80, 20)]
    assert sorted(found.columns) == ["i", "k", "v"]
    left = {r.i: r.v for r in skew.lookup(rows, entries, "k", hot, ["i"], "left").collect()}
    assert len(left) == rows.count() and left[81] is None and left[84] is None and left[5] == 10


def test_a_key_of_many_rows_is_split(spark):
    """No task of the lookup gets more than a few times ``most`` rows of one key, in whatever share it is."""
    rows = spark.range(4000).select("id", F.when(F.col("id") % 250 < 249, F.concat(F.lit("k"), F.col("id") % 3)).otherwise("rare").alias("k"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.hot_keys(counts, "k", most=100)
    joined = skew.lookup(rows, counts.withColumnRenamed("n", "v"), "k", hot, ["id"])
    assert joined.count() == 4000 and {r.parts for r in hot.collect()} == {14}


# nested records


def _brute(column, value):
    """Recursive reference for the paths of listed objects."""
    out = set()

    def walk(path, v):
        v = nested.unwrapped(v)
        if isinstance(v, dict):
            for k, x in v.items():
                x = nested.unwrapped(x)
                if k in nested.LISTS:
                    x = [x] if isinstance(x, dict) else x
                    if isinstance(x, list):
                        out.update(f"{path}.{k}[{i}]" for i, y in enumerate(x) if isinstance(nested.unwrapped(y), dict))
                walk(f"{path}.{k}", x)
        elif isinstance(v, list):
            for i, y in enumerate(v):
                walk(f"{path}[{i}]", y)

    walk(column, value)
    return out


keys = st.sampled_from(["a", "b", *nested.LISTS])
trees = st.recursive(st.none() | st.booleans() | st.integers(0, 3) | st.sampled_from(["", "x", "{", '"q"']), lambda t: st.lists(t, max_size=3) | st.dictionaries(keys, t, max_size=3) | t.map(json.dumps), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(trees)
def test_paths_against_recursion(tree):
    text = json.dumps(tree)
    got = {r[1] for r in nested.occurrences(1, "contents", text) if r[3] in nested.LISTS and r[4] is not None}
    assert got == _brute("contents", text)


def test_equal_objects_share_a_hash():
    rows = nested.occurrences(1, "c", {"x": {"b": 1, "a": [2]}, "y": {"a": [2], "b": 1}, "z": {"a": [2, 2], "b": 1}})
    by = {r[1]: r[6] for r in rows}
    assert by["c.x"] == by["c.y"] != by["c.z"]


def test_records_can_be_rebuilt(spark, data):
    """From objects and bridge, scalars in lists and lists in lists included."""
    cases = [{"a": [1, "x", None, [2, [True, "{"], []], {"b": ["y"]}], "e": {}}, [], [[["z"]]], "plain", 3.5, {"kill_chain_phases": {"p": "\"q,]}"}}]
    for value in cases:
        rows = nested.occurrences(1, "c", value, lists=(), unwrap=False, whole=True)
        assert nested.rebuilt(next(r[6] for r in rows if r[1] == "c"), {r[6]: r[7] for r in rows}) == value
    records = spark.read.parquet(f"{data}/mitre.parquet")
    bridge = nested.bridge(records, columns=("contents",), lists=(), whole=True)
    bodies = {r.object_hash: r.body for r in nested.objects(bridge).collect()}
    roots = {r.rec_id: r.object_hash for r in bridge.where("path = 'contents'").collect()}

    def read(v):
        v = nested.unwrapped(v)
        return {k: read(x) for k, x in v.items()} if isinstance(v, dict) else [read(x) for x in v] if isinstance(v, list) else v

    want = {r.rec_id: read(r.contents) for r in records.where("contents is not null").collect()}
    assert {k: nested.rebuilt(h, bodies) for k, h in roots.items()} == want


def test_flat_tables(spark, data):
    """Every place of p2_found is a row of one of the two tables, with its values."""
    from spindrift.plans import nested as plans

    phases, references = plans.p2_phase_rows(spark, data), plans.p2_reference_rows(spark, data)
    places = lambda *dfs: sorted((r.rec_id, r.path) for df in dfs for r in df.collect())
    assert places(phases, references) == places(plans.p2_found(spark, data))
    column = {(r.rec_id, r.ordinal, r.kill_chain_name, r.phase_name) for r in phases.where("parent_path is null").collect()}
    assert column == {(r.rec_id, r.ordinal, r.chain, r.phase) for r in plans.p2_phases(spark, data).collect()}
    assert phases.where("path like 'contents%' and phase_name is not null").count() and references.where("source_name is not null").count()


def test_nested_edge_rows(spark):
    schema = "rec_id long, external_references array<struct<source_name:string,external_id:string>>, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, contents string, path string"
    deep = "[" * 300 + '{"kill_chain_phases": {"a": 1}}' + "]" * 300
    df = spark.createDataFrame([(1, [None, ("a", None)], None, '{"x": ', "p"), (2, None, [], None, None), (3, None, None, json.dumps(json.dumps({"external_references": ["s", {}, None]})), ""), (4, None, None, deep, ""), (1, [None, ("a", None)], None, "", "")], schema)
    found = sorted((r.rec_id, r.path) for r in nested.listed(nested.bridge(df)).collect())
    assert found == [(1, "external_references[1]")] * 2 + [(3, "contents.external_references[1]"), (4, "contents" + "[0]" * 300 + ".kill_chain_phases[0]")]
    assert nested.bridge(df.where("false")).count() == 0
    assert nested.objects(nested.bridge(df)).where("occurrences = 2").count() == 1


# matching


def test_greedy_order_and_passes():
    e = lambda s, r, o: (s, set(s.split()), r, o, set(o.split()))
    p, g = [e("fox", "uses", "nmap"), e("red fox", "uses", "nmap")], [e("red fox", "uses", "nmap"), e("owl", "uses", "nmap")]
    assert matching.greedy(p, g, matching.PASSES["rel_eq"]) == 1
    assert matching.greedy(p, g, matching.PASSES["triplet"]) == 1
    assert matching.greedy([e("a", "drops", "b")], [e("b", "uses", "a")], matching.PASSES["compat"]) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=4), max_size=5))
def test_largest_matching(left):
    def best(i, used):
        return 0 if i == len(left) else max([best(i + 1, used)] + [1 + best(i + 1, used | {j}) for j in left[i] if j not in used])

    assert matching.largest_matching(left) == best(0, frozenset())


# texts


def reference_chunks(text, limit):
    import re

    text = text.strip()
    out, buf = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(p) > limit:
            if buf:
                out.append(buf)
            buf, part = "", ""
            for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", p)):
                if part and len(part) + len(s) + 1 > limit:
                    out.append(part)
                    part = s
                else:
                    part = f"{part} {s}" if part else s
            if part:
                out.append(part)
        elif buf and len(buf) + len(p) + 2 > limit:
            out.append(buf)
            buf = p
        else:
            buf = f"{buf}\n\n{p}" if buf else p
    return out + [buf] if buf else out


def test_chunks_against_loop(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, ""), (-2, " \n "), (-3, "Aa. Bb. " * 50 + "\n\nshort\n\nother"), (-4, "x" * 5000)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.unionByName(extra).collect()}
    for limit in (2000, 120):
        got = {}
        for r in segment.chunks(docs.unionByName(extra), limit).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append(r.text)
            assert r.char_end - r.char_start == len(r.text)
        want = {k: c for k, t in texts.items() if (c := reference_chunks(t, limit))}
        assert got == want


def test_leaders_and_nearest_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 0), (4, [0.0, 0.0], 1)], "id long, v array<double>, label int")
    assert {(r.id, r.leader) for r in retrieve.leaders(v, "label", 0.9).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert [(r.q, r.e) for r in retrieve.nearest(v, v.where("id = 1"), 1).collect()] == [(1, 2)]
    assert retrieve.nearest(v.where("false"), v.where("id = 1"), 1).count() == 0


def test_index_recall(spark, data):
    """The index finds nine tenths or more of the exact neighbours, and all of them if it visits all cells."""
    v = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id as id", "embedding as v")
    asked = v.where("id % 10 = 0")
    pairs = lambda df: {(r.q, r.e) for r in df.collect()}
    exact = pairs(retrieve.nearest(v, asked))
    assert pairs(retrieve.indexed_nearest(v, asked, cells=8, visited=1.0, size=50)) == exact
    assert len(pairs(retrieve.indexed_nearest(v, asked, cells=16)) & exact) >= 0.9 * len(exact)
    assert retrieve.indexed_nearest(v.where("false"), asked).count() == 0


def test_chunks_by_sentences(spark):
    df = spark.createDataFrame([(1, "Aa one. Bb two. Cc three.\n\nDd four."), (2, None), (None, "Xx.")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.chunk_index, r.text) for r in segment.chunks(df, 2000, 2).collect()) == [(0, 0, "Xx."), (1, 0, "Aa one. Bb two."), (1, 1, "Cc three. Dd four.")]


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from spindrift import lineage

    class Spark:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Spark)


def test_few_shot_outputs_and_own_document(spark):
    q = spark.createDataFrame([(1, "alpha beta", "d1")], "id long, text string, doc string")
    e = spark.createDataFrame([(1, "alpha beta", "zeta", "d1"), (2, "alpha gamma", "beta", "d2"), (3, "delta", "alpha beta", "d3"), (4, "delta", "eta", "d4")], "id long, text string, output string, doc string")
    got = [(r.e, r.score) for r in retrieve.few_shot(q, e, 5).orderBy("rank").collect()]
    want = {2: 0.7 / 3 + 0.25 / 2 + 25 / 11, 3: 0.25 + 25 / 5}
    assert got == sorted(((k, round(v, 9)) for k, v in want.items()), key=lambda x: -x[1])


def test_graph_resolves_names(spark):
    """Aliases, techniques and similar names come together before edges are fused."""
    from spindrift import pipeline

    raw = "seq long, doc string, chunk string, s string, st string, rel string, o string, ot string, ev string, conf double, status string, aids array<string>"
    rows = [(1, "d1", "c1", "APT29", "ThreatActor", "uses", "spear-phishing", "Technique", "", 0.8, "validated", ["T1"]), (2, "d2", "c2", "Cozy Bear", "ThreatActor", "uses", "Spear Phishing", "Technique", "", 0.9, "validated", []),
            (3, "d3", "c3", "APT 29", "ThreatActor", "uses", "Spear Phishing", "Technique", "", 0.7, "validated", []), (4, "d3", "c3", "Cozy Bear", "ThreatActor", "uses", "spear-phishing", "Technique", "", 0.7, "rejected", [])]
    mitre = spark.createDataFrame([(1, "intrusion-set", "APT29", ["Cozy Bear"], None, []), (2, "attack-pattern", "Spear Phishing", [], "T1566", [])], "rec_id long, type string, name string, aliases array<string>, mitre_id string, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>").selectExpr(
        "*", "type as object_type", "name as title", "cast(array() as array<struct<source_name:string,external_id:string>>) as external_references")
    vectors = spark.createDataFrame([("ThreatActor", "APT29", [1.0, 0.0]), ("ThreatActor", "APT 29", [1.0, 0.1])], "type string, name string, v array<double>")
    kg, steps = spark.createDataFrame(rows, raw), pipeline.Steps(pronouns=False, repair=False, validation=False)
    done = {r.seq: r for r in pipeline.resolved(kg, mitre, steps).collect()}
    assert [(done[i].s, done[i].o, done[i].aids) for i in (1, 2, 4)] == [("APT29", "Spear Phishing", ["T1", "T1566"]), ("APT29", "Spear Phishing", ["T1566"]), ("Cozy Bear", "spear-phishing", [])]
    nodes, edges = pipeline.graph(kg, mitre, steps)
    assert nodes.count() == 3 and sorted((r.ks, r.docs, r.conf) for r in edges.collect()) == [("apt 29", 1, 0.7), ("apt29", 2, 0.95)]
    assert pipeline.resolved(kg, mitre, pipeline.Steps(pronouns=False, repair=False, validation=False, align_from=0.9), vectors).count() == 4  # each document by itself
    same = pipeline.resolved(kg.withColumn("doc", F.lit("d1")), mitre, pipeline.Steps(pronouns=False, repair=False, validation=False, align_from=0.9), vectors).collect()
    assert sorted((r.seq, r.s) for r in same) == [(1, "APT29"), (4, "Cozy Bear")]


def test_pipeline_labels(spark):
    arms = pipeline.ablation(kg(spark, {}, {"s": ""}), [pipeline.Steps(), pipeline.Steps(validation=False)]).collect()
    assert {(r.arm, r.status, r.n) for r in arms} == {("P+R+V", "rejected", 1), ("P+R+V", "validated", 1), ("P+R", "raw", 2)}


@pytest.mark.parametrize("rel", ["related_to", "associated_with"])
def test_repair_uses_types(spark, rel):
    from spindrift.operators.relation_repair import repair_relations

    row = repair_relations(kg(spark, {"rel": rel, "st": "ThreatActor", "status": "validated"})).first()
    assert (row.rel, row.status) == ("uses", "repaired")
