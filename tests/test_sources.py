import json

from pyspark.sql import functions as F

from spindrift.sources import adapters, readers, responses, writers
from spindrift.streaming import flows


def test_annotations(spark, tmp_path):
    good = {"text": "t", "entities": [{"entity_name": "Fox", "entity_type": "Tool"}, {"entity_name": "Fox", "entity_type": "Malware"}], "explicit_triplets": [{"subject": "Fox", "relation": "attacked", "object": "Ox"}]}
    (tmp_path / "a b.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "note.txt").write_text("x")
    docs, gold = readers.annotations(spark, str(tmp_path))
    assert [r.doc_id for r in docs.collect()] == ["a b"]
    assert [tuple(r)[2:] for r in gold.collect()] == [("Fox", "Malware", "targets", "Ox", "Other")]


def test_plain_texts_and_lines(spark, tmp_path):
    (tmp_path / "my-first_report.txt").write_text("one\ntwo")
    row = readers.plain_texts(spark, str(tmp_path)).first()
    assert (row.doc_id, row.title, row.text) == ("my-first_report", "My First Report", "one\ntwo")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2


def test_bracket_and_python_graphs(spark):
    df = spark.createDataFrame([("see [a, uses, b, c] and [x, y] and [z]",), (None,)], "t string")
    got = [r.e for r in df.select(readers.bracket_triples(F.col("t")).alias("e")).collect()]
    assert [tuple(x) for x in got[0]] == [("a", "uses", "b, c"), ("x", "y", "")] and got[1] is None
    df = spark.createDataFrame([("{'edges': [{'sub': 'a', 'rel': 'r', 'obj': 'b'}, {'sub': 'a'}]}",), ("[",)], "t string")
    got = [r.e for r in df.select(readers.python_graph("t").alias("e")).collect()]
    assert [tuple(x) for x in got[0]] == [("a", "r", "b")] and got[1] is None


def test_expanded(spark):
    df = spark.createDataFrame([(["a", " ", "b"], [], ["c", "d"])], "x array<string>, y array<string>, z array<string>")
    assert {(r.s, r.r, r.o) for r in readers.expanded(df, "x", "y", "z").collect()} == {(s, "", o) for s in "ab" for o in "cd"}


def test_responses():
    t = {"subject": "a", "relation": "uses", "object": "b"}
    cut = '{"triples": [' + json.dumps(t) + ", " + json.dumps(t | {"object": "c"}) + ", " + json.dumps(t) + ', {"subject": "cut'
    ab = [("a", "b")]
    cases = {
        json.dumps({"triples": [t]}): ab, "Sure:\n```json\n" + json.dumps([t]) + "\n```": ab, "{'triples': [{'subject': 'a', 'relation': 'uses', 'object': 'b',},]}": ab, cut: [("a", "b"), ("a", "c"), ("a", "b")],
        "JSON: " + json.dumps({"predicted_triple": t}): ab, "so {x} then " + json.dumps(t) + " }": ab, json.dumps([1, t]): [None, ("a", "b")], json.dumps({"triplets": [{"subject": None, "object": "b"}]}): [(None, "b")],
        '{"triples": [{"subject": "a}", "object": "b\\" {"}]}': [("a}", 'b" {')],
    }
    for text, want in cases.items():
        assert [x and (x["subject"], x["object"]) for x in responses.triples_in(text)] == want, text
    assert responses.triples_in(None) == responses.triples_in("no") == responses.triples_in("{}") == responses.triples_in('{"subject": "a", "object": "b"}') == []


def test_parsed_fast_and_slow_agree(spark):
    t = {"subject": "a", "relation": "uses", "object": "b", "evidence": "x"}
    texts = [json.dumps({"triples": [t, t]}), "```json\n" + json.dumps({"triples": [t]}) + "\n```", json.dumps({"triples": []}), "[]", None, "", json.dumps({"triples": [t | {"object": None}]}), "no json", json.dumps({"triple": t})]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", responses.parsed(F.col("t")).alias("p")).orderBy("i").collect()
    plain = lambda x: [{k: v for k, v in r.asDict().items()} for r in x or []]
    assert [plain(r.p) for r in rows] == [responses.triples_in(x) for x in texts]


def test_replayed(spark):
    ask = spark.createDataFrame([("m", "p"), ("m", "q")], "model string, prompt string")
    stored = ask.where("prompt = 'p'").select(responses.prompt_key(F.col("model"), F.col("prompt")).alias("key"), F.lit("yes").alias("response"))
    assert {(r.prompt, r.response) for r in responses.replayed(ask, stored.unionByName(stored)).collect()} == {("p", "yes"), ("q", None)}


def test_render(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(responses.render("{a}: {b}; {c} {{a}}", a=F.col("a"), b=F.col("b")).alias("t")).first().t == "x: ; {c} {x}"


def test_examples_and_gold(spark, tmp_path):
    good = {"text": " some  text ", "entities": [{"entity_name": "Fox", "entity_type": "Malware"}], "explicit_triplets": [{"subject": "Fox", "relation": "hit", "object": "Ox"}] * 9}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({"text": "", "explicit_triplets": []}))
    (tmp_path / "c.json").write_text("{")
    row = readers.examples(spark, str(tmp_path), triples=2, chars=6).collect()
    assert len(row) == 1 and (row[0].doc, row[0].text) == ("a", "some t")
    assert json.loads(row[0].output)["triples"] == [{"subject": "Fox", "subject_type": "Malware", "relation": "hit", "object": "Ox", "object_type": "Other", "evidence": ""}] * 2
    df = spark.createDataFrame([("d", json.dumps([{"sub": "a", "rel": "r", "obj": "b"}, {"sub": "", "obj": "c"}, {"sub": "x", "obj": "y"}])), ("e", "[")], "file_name string, ground_truth_json string")
    assert [tuple(r) for r in readers.gold_records(df).orderBy("i").collect()] == [("d", 0, "a", "r", "b"), ("d", 2, "x", "", "y")]


def test_systems_and_calibration(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/1.json").write_text(json.dumps({"file_name": "d", "generated_graph": {"relations": [{"sub": "a", "rel": None, "obj": ["x", " ", "y"]}, {"sub": "b", "rel": "r", "obj": ""}]}}))
    (tmp_path / "s/2.json").write_text("nope")
    assert {tuple(r) for r in readers.system_outputs(spark, str(tmp_path / "s")).collect()} == {("d", "a", "", "x"), ("d", "a", "", "y")}
    edge = {"sub": "a", "rel": "r", "obj": "b"}
    rows = [
        {"Human Agreement": "Agree", "Review edge": edge, "Type": "Precision", "Ground Truth Graph": [edge], "LLM Decision": "TP"},
        {"Human Agreement": "Disagree", "Review edge": edge, "Type": "Recall", "Predict Graph": "{'relations': [{'sub': 'x', 'rel': 'r', 'obj': 'y'}]}", "LLM Decision": "fn"},
        {"Human Agreement": "Undecided", "Review edge": edge, "Type": "Recall", "Predict Graph": [edge], "LLM Decision": "TP"},
        {"Human Agreement": "Agree", "Review edge": {"sub": "", "obj": "b"}, "Type": "Precision", "Ground Truth Graph": [edge], "LLM Decision": "TP"},
        {"Human Agreement": "Agree", "Review edge": edge, "Type": "Precision", "Ground Truth Graph": [], "LLM Decision": "TP"},
    ]
    (tmp_path / "reviewer.json").write_text(json.dumps(rows))
    got = readers.calibration_items(spark, str(tmp_path / "reviewer.json")).orderBy("type").collect()
    assert [(r.type, r.judge, r.human, [tuple(g) for g in r.graph]) for r in got] == [("Precision", True, True, [("a", "r", "b")]), ("Recall", False, True, [("x", "r", "y")])]


def test_sentence_table_and_runs(spark, tmp_path):
    (tmp_path / "s.csv").write_text('sentence,x,y,tactic,gold,baseline\n"one, two",,,t,"[a, r, b]","[a, r] [c]"\n')
    row = readers.sentence_table(spark, str(tmp_path / "s.csv")).first()
    assert (row.sentence, row.tactic, [tuple(g) for g in row.gold], [tuple(g) for g in row.baseline]) == ("one, two", "t", [("a", "r", "b")], [("a", "r", "")])
    for n, f1 in ((1, 0.5), (2, None)):
        (tmp_path / f"runs/pass_{n}").mkdir(parents=True)
        (tmp_path / f"runs/pass_{n}/r.json").write_text(json.dumps({"B": {"f1": f1}, "C": {"f1": 0.7}}))
    assert {tuple(r) for r in readers.run_results(spark, str(tmp_path / "runs"), {"b": "B.f1", "c": "C.f1"}).collect()} == {("1", "b", 0.5), ("1", "c", 0.7), ("2", "c", 0.7)}


def test_adapters(spark):
    value = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert [value(adapters.first_type, x) for x in ("Threat Actor", "indicator:file", "thing")] == ["ThreatActor", "IOC", "Other"]
    assert [value(adapters.second_type, x) for x in ("vulnerable_software", "attack-pattern", "Registy", "System")] == ["Software", "Technique", "IOC", "Software"]
    assert [value(adapters.second_relation, x) for x in ("Beacon-To", "deployed on", "is behind", "eats")] == ["communicates_with", "uses", "attributed_to", "related_to"]
    text = "1. Fox (malware); use; Ox(Tool)\n* Owl; target; Elm (organization)\nbad; line\n"
    rows = adapters.text_triples(spark.createDataFrame([("d", "t", text), ("e", "t", None)], "doc string, tactic string, text string")).orderBy("i").collect()
    assert [(r.s, r.st, r.rel, r.o, r.ot) for r in rows] == [("Fox", "Malware", "uses", "Ox", "Tool"), ("Owl", "Other", "targets", "Elm", "Organization")]


def test_log_sink_and_unreadable(spark, tmp_path):
    log = spark.createDataFrame([("a", "flagged", 1), ("a", "rejected", 2)], "category string, action string, seq int")
    writers.write_log(log, str(tmp_path))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert {(r.level, r.value, r.n) for r in spark.read.json(str(tmp_path / "summary")).collect()} >= {("all", "", 2), ("category", "a", 2)}
    df = spark.createDataFrame([("c/1 x", "p", "no"), ("c2", "p", '{"triples": [{"subject": "a"}]}')], "chunk_id string, prompt string, response string")
    assert [r.chunk_id for r in writers.unreadable(df).collect()] == ["c_1_x"]


def test_verdicts_and_sentences(spark):
    df = spark.createDataFrame([('x [{"result": "TP1"}, {"result": "FP"}, {}]',), ("none",)], "t string")
    assert [tuple(r.v) for r in df.select(responses.verdicts(F.col("t")).alias("v")).collect()] == [(1, 2), (0, 0)]
    df = spark.createDataFrame([("uses",), ("eats_up",), ("",)], "r string")
    assert [r.t for r in df.select(responses.verbalize(F.lit("A"), F.col("r"), F.lit("B")).alias("t")).collect()] == ["A uses B.", "A eats up B.", "A is related to B."]


def test_writers(spark, data, tmp_path):
    triples, entities = spark.read.parquet(f"{data}/triples.parquet"), spark.read.parquet(f"{data}/entities.parquet")
    writers.write_graph(entities, triples, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g/nodes")).count() == entities.count()
    writers.write_csv(writers.edge_rows(triples), str(tmp_path / "e"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "e"))
    assert back.count() == triples.where("validation_status in ('validated', 'repaired')").count() and len(back.columns) == 12
    assert writers.node_rows(entities).count() == entities.count()


def test_streams_equal_batches(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = flows.hourly_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "0 seconds")
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: {(r.hour, r.event_type): r.n for r in df.collect()}
    assert key(spark.table("hourly")) == key(flows.hourly_counts(events))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "docs"))
    q = flows.chunk_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))).writeStream.format("memory").queryName("pieces").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("pieces").count() == flows.chunk_stream(docs).count()
    triples = spark.read.parquet(f"{data}/triples.parquet").where("loaded_at is not null and event_id is not null").select("event_id", "loaded_at")
    triples.write.parquet(str(tmp_path / "tr"))
    q = flows.first_deliveries(spark.readStream.schema(triples.schema).parquet(str(tmp_path / "tr")), "4000 days").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == flows.first_deliveries(triples).count()
