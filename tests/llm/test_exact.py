"""The operators that have one right answer, against plain Python over small fixtures."""


import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import encode, groups, leaks, pieces, same_writing, survivors

TRIPLE = "seq long, event_id string, confidence double, evidence_text string, validation_status string, loaded_at timestamp, n int, _key string"


# 1: survivors


def brute_survivors(rows):
    out, by = {}, defaultdict(list)
    for r in rows:
        if r.event_id is not None:
            by[r.event_id].append(r)
    for event, g in by.items():
        if len(g) < 2:
            continue
        status = {r.seq: (r.validation_status or "").strip().lower() for r in g}
        everyone = all(status[r.seq] == "rejected" for r in g)
        when = lambda r: (r.loaded_at is not None, r.loaded_at.timestamp() if r.loaded_at else 0, r.seq)

        def best(score, barred=True):
            c = [(score(r), *when(r)) for r in g if score(r) is not None and (not barred or everyone or status[r.seq] != "rejected")]  # noqa: B023
            return max(c)[-1] if c else None

        trust = {s: -i for i, s in enumerate(survivors.TRUST_ORDER)}
        out[event] = (
            best(lambda r: r.confidence if r.confidence is not None and 0 <= r.confidence <= 1 else None),
            best(lambda r: len(re.sub(r"\s", "", r.evidence_text)) or None if r.evidence_text else None),
            best(lambda r: trust.get(status[r.seq]), False),  # noqa: B023
        )
    return out


def test_survivors(spark):
    import datetime

    rng = random.Random(5)
    at = [None, *(datetime.datetime(2030, 1, d) for d in (1, 2, 3))]
    rows = [(i, rng.choice(["e%d" % rng.randrange(60), "hot", None]) if rng.random() < 0.5 else "e%d" % rng.randrange(60), rng.choice([None, float("nan"), -1.0, 2.0, 0.0, 0.5, 0.5, 1.0]), rng.choice([None, "", "  ", "a", "a b", "abc"]), rng.choice([None, "", "Validated ", "raw", "REJECTED", "rejected", "repaired ", "ok?"]), rng.choice(at), 1, "x") for i in range(700)]
    df = spark.createDataFrame(rows, TRIPLE)
    got = {r.event_id: (r.confidence_from, r.evidence_from, r.status_from) for r in survivors.claim_survivors(df).collect()}
    assert got == brute_survivors(df.collect())
    assert survivors.claim_survivors(df.where("false")).count() == 0
    values = {r.event_id: r for r in survivors.surviving_records(df).collect()}
    by = {r.seq: r for r in df.collect()}
    assert set(values) == set(got)
    for e, (c, _, s) in got.items():
        assert values[e].confidence == (by[c].confidence if c is not None else None)
        assert values[e].validation_status == (by[s].validation_status if s is not None else None)


def brute_layers(rows, dims):
    """The layer of each row of one group, by peeling as it is defined."""
    left, out, k = list(rows), {}, 1
    worse = lambda c, d: d is not c and d.at > c.at and all(x >= y for x, y in zip(dims(d), dims(c)))
    while left:
        top = [c for c in left if not any(worse(c, d) for d in left)]
        out |= {c.id: k for c in top}
        left, k = [c for c in left if c not in top], k + 1
    return out


def test_layers_fill_nulls(spark):
    """A field that only dominated records have is filled from the next layer, not from the best score."""
    df = spark.createDataFrame([(1, "k", 0.9, None, 1, 1), (2, "k", None, "x", 3, 9), (3, "k", 0.5, None, 2, 5), (4, "k", 1.0, None, 1, 0)], "id long, k string, v double, w string, trust int, t int")
    fields = [survivors.Field("v", F.col("v")), survivors.Field("w", F.when(F.col("w").isNotNull(), 1.0))]
    one = survivors.skyline(df, "k", fields, [F.col("trust")], F.lit(False), F.col("t"), "id").first()
    assert (one.n, one.v_from, one.w_from) == (4, 3, 2)
    shallow = survivors.skyline(df, "k", fields, [F.col("trust")], F.lit(False), F.col("t"), "id", layers=1).first()
    assert (shallow.v_from, shallow.w_from) == (4, 2)  # beyond the layers told apart the policy decides


@pytest.mark.parametrize("most", [10, 2000])
def test_layers_by_definition(spark, most):
    """Hot groups, small batches and parts give what peeling whole groups gives."""
    from collections import namedtuple

    row = namedtuple("row", "id k v trust full at")
    rng = random.Random(4)
    rows = [row(i, rng.choice(["hot", f"k{rng.randrange(20)}"]), rng.choice([None, 0.1, 0.5, 0.5, 0.9]), rng.randrange(4), rng.randrange(3), i * 7919 % 600) for i in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.createDataFrame([tuple(r) for r in rows], "id long, k string, v double, trust int, full int, at int").repartition(3)
        got = {r.k: (r.n, r.v_from) for r in survivors.skyline(df, "k", [survivors.Field("v", F.col("v"))], [F.col("trust"), F.col("full")], F.lit(False), F.col("at"), "id", most=most).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(list)
    for r in rows:
        by[r.k].append(r)
    want = {}
    for k, g in by.items():
        layer = brute_layers(g, lambda r: (r.trust, r.full))
        usable = [(-min(layer[r.id], survivors.LAYERS + 1), r.v, r.at, r.id) for r in g if r.v is not None]
        if len(g) > 1:
            want[k] = (len(g), max(usable)[-1] if usable else None)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=120))
def test_layers_side_by_side_and_one_by_one(rows):
    rows = sorted(rows, key=lambda r: r[0])
    group, v = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], float)
    want = []
    for i, r in enumerate(rows):
        want.append(1 + max([want[j] for j in range(i) if group[j] == group[i] and (v[j] >= v[i]).all()], default=0))
    assert survivors.layers_of(group, v, 3).tolist() == [min(x, 4) for x in want]


# 3: same writing


def key(x):
    return "".join(c for c in (x or "").casefold() if c.isalnum())


def brute_groups(records):
    g = defaultdict(list)
    for r in records:
        g[tuple(key(x) for x in r[1:])].append(r[0])
    return {s: (min(v), len(v)) for v in g.values() for s in v}


@pytest.mark.parametrize("most", [40, 299, 10_000])
def test_collapse_hot_and_cold(spark, most):
    rng = random.Random(2)
    spell = ["Fox", " fox", "F-O-X", "fo​x", None, "", "Straße", "STRASSE", "ox", "x" * 50_000]
    rows = [(i, *(("Fox", "uses", "A") if i % 3 == 0 else (rng.choice(spell), rng.choice(["uses", "Uses!"]), rng.choice(spell)))) for i in range(900)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "seq long, subject string, relation string, object string, first string")
    got = {r.seq: (r.first, r.copies) for r in same_writing.collapse(df, "seq", same_writing.FIELDS, most=most).collect()}
    assert got == brute_groups(rows)
    assert same_writing.collapse(df.where("false"), "seq", same_writing.FIELDS).count() == 0


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('{"object": "o", "subject": "s", "relation": null}', ("s", None, "o")), ("```json\n{\"SUBJECT\":\"s\",\"RELATION\":\"r\",\"OBJECT\":\"o\"}\n```", ("s", "r", "o")),
        ("{'subject': \"it's\", 'relation': None, 'object': ''}", ("it's", None, "")), ("relation=r | object=a=b | subject=", ("", "r", "a=b")), ("Subject: a | b; Relation: r; Object: c: d", None), ("Subject: a; Relation: r; Object: c: d", ("a", "r", "c: d")),
        ('{"subject": "s", "relation": "r", "obj', None), ("subject=s | relation=r", None), ("", None), (None, None), ("[1]", None),
    ],
)
def test_notations(line, want):
    got = same_writing.parse_record(line)
    assert (got and tuple(got[f] for f in same_writing.FIELDS)) == want


def test_claims(spark, data):
    triples, raw = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("triples", "raw_triples"))
    records = [tuple(r) for r in same_writing.claim_records(triples, raw).collect()]
    want = brute_groups(records)
    got = {r.first_seq: r.copies for r in same_writing.claims(triples, raw).collect()}
    assert got == dict(set(want.values()))
    parsed = [same_writing.parse_record(r.record) for r in raw.select("record").collect()]
    assert len(records) == triples.count() + sum(p is not None for p in parsed)


# 4: pieces


texts = st.text(alphabet=st.sampled_from(list("ab .,\n\t\r!?é \U0001f525")), max_size=400)
SMALL = pieces.Sizes(largest=60, smallest=20, overlap=10, reach=15, landmark_bits=4)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_pieces_cover_and_overlap(text):
    """Pieces cover the text, none exceeds the limit, and each begins before the one before it ends."""
    end = 0
    for i, (a, b, _, _) in enumerate(pieces.cuts(text, SMALL)):
        assert (0 < end - a <= SMALL.overlap if i else a == 0) and end < b and b - a <= SMALL.largest
        end = b
    assert end == len(text)


def test_hard_cuts_overlap_fully():
    cut = pieces.cuts("x" * 9000, pieces.Sizes())
    assert all(b - a == 2000 for a, b, *_ in cut[:-1]) and all(x[1] - y[0] == 200 for x, y in zip(cut, cut[1:]))


def brute_paragraphs(t):
    spans, cur, pos = [], None, 0
    for line in [*t.split("\n"), ""]:
        if line.strip(" \t\r"):
            cur = (cur[0] if cur else pos, pos + len(line))
        elif cur:
            part = t[cur[0] : cur[1]]
            a = cur[0] + len(part) - len(part.lstrip(" \t\r\n"))
            spans.append((a, a + len(part.strip(" \t\r\n"))))
            cur = None
        pos += len(line) + 1
    return spans


@settings(max_examples=300, deadline=None)
@given(texts)
def test_cuts_tell_long_paragraphs(text):
    """Every paragraph beyond the limit is divided by a cut, and told once."""
    told = [d for *_, d in pieces.cuts(text, SMALL) if d and d[1] - d[0] > SMALL.largest]
    assert told == [s for s in brute_paragraphs(text) if s[1] - s[0] > SMALL.largest]


def test_oversized(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "y" * 30_000), (-4, "y" * 30_000)], "doc_id long, text string"))
    want = sorted((r.doc_id, a, b) for r in docs.collect() if r.text for a, b in brute_paragraphs(r.text) if b - a > 2000)
    assert sorted(tuple(r) for r in pieces.oversized_paragraphs(docs).collect()) == want
    assert pieces.split_texts(docs.where("false")).count() == 0
    got = pieces.split_texts(docs.withColumn("chunk_id", F.lit("clash"))).collect()
    assert all(len(r.text) <= 2000 for r in got) and {r.doc_id for r in got} == {r.doc_id for r in docs.collect() if r.text and r.text.strip()}


def test_an_edit_moves_only_near_cuts():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ".", ","]) for _ in range(20_000))
    ends = lambda t: {len(t) - b for _, b, *_ in pieces.cuts(t, pieces.Sizes())}
    a, b = ends(text), ends("something new. " + text)
    assert len(a & b) >= 0.9 * len(a)


# 5: groups


@pytest.mark.parametrize("cell", [1, 7, 10_000])
def test_components(spark, cell):
    rng = random.Random(cell)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(70)] + [("hub", f"n{i}") for i in range(0, 120, 3)] + [(f"c{i}", f"c{i + 1}") for i in range(60)] + [(None, "n1"), ("z", "z"), ("n1", None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(*e, 1) for e in edges], "a string, b string, v int")
    got = {r.node: r.group for r in groups.components(df, cell=cell).collect()}
    assert got == {x: root(x) for x in parent}
    assert groups.components(df.where("false")).count() == 0


def test_merge_messages(spark):
    rows = [
        ("a:1", "node", ["took over mentions of \"a:2.\"", "merged from doc1 and doc2", None]), ("a:3", "node", ["absorbed a:4 (same sample set)", "split a:4 off again"]), ("a:5", "node", ["undid the merge with a:6", "joined: a:5 + a:6"]),
        ("a:7", "node", ["candidate a:8 turned down by reviewer", "not the same as a:9", "kept apart from a:10: other chain"]), ("a:1", "edge", ["alias hit -> a:11"]), ("a:12", "node", ["merged a:13 into a:12", "a:13 released, was wrongly folded in", "a:13 folded in after review"]),
        ("a:14", "node", None), ("a:15", "node", ["a:15 <- a:16"]), ("a:15", "node", ["a:15 <- a:16"]), ("a:20", "node", ["merged a:21 into a:22"]),
    ]
    df = spark.createDataFrame(rows, "element_id string, element_type string, merge_history array<string>")
    assert {tuple(r) for r in groups.merge_edges(df).collect()} == {("a:1", "a:2."), ("a:5", "a:6"), ("a:12", "a:13"), ("a:15", "a:16"), ("a:21", "a:22")}


def test_node_groups(spark):
    ents = spark.createDataFrame([("a", "T", ["X ", "n/a"]), ("b", "T", [" x"]), ("c", "U", ["x"]), ("d", "T", None), ("e", None, ["x"]), ("f", "T", ["n/a", None])], "node_id string, entity_type string, aliases array<string>")
    pairs = spark.createDataFrame([("d", "c"), ("c", "d"), ("f", None)], "node_id_1 string, node_id_2 string")
    prov = spark.createDataFrame([], "element_id string, element_type string, merge_history array<string>")
    assert {r.node_id: r.group_node_id for r in groups.node_groups(ents, pairs, prov).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "f"}


# 8: encoding


def test_encode_and_decode(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    strange = [None, "", " ", "\n\n  x", "don't stop'll", "<|endoftext|> x", "🔥🐍 𝔸𝔹", "a" * 30_000, "été 12٣", " nbsp​zero", "Ω" * 2000, "''re !! \t\t "]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(strange, 1)] + [(-1, "again")], "doc_id long, text string"))
    rust = tokenizers.Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    rust.encode_special_tokens = True
    rows = docs.collect()
    want = sorted((r.doc_id, tuple(e.ids)) for r, e in zip(rows, rust.encode_batch([r.text or "" for r in rows], add_special_tokens=False)))
    got = encode.encode(docs.withColumn("ids", F.lit(1)).withColumn("block", F.lit(2)))
    assert sorted((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    back = sorted((r.doc_id, r.text) for r in encode.decode(got).collect())
    assert back == sorted((r.doc_id, r.text or "") for r in rows)
    assert encode.encode(docs.where("false")).count() == 0


def test_small_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} x y{i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    whole = sorted((r.doc_id, tuple(r.ids)) for r in encode.encode(docs).collect())
    assert len(whole) == 50 and len({i for _, i in whole}) == 50


# 9: leaks


def brute_leaks(docs, items, least):
    word = re.compile(r"[^\W_]+")
    seeds = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").casefold())
        for k in range(len(w) - least + 1):
            seeds[tuple(w[k : k + least])].add(i)
    out = set()
    for d, t in docs:
        w = word.findall((t or "").casefold())
        for k in range(len(w) - least + 1):
            out.update((i, d) for i in seeds.get(tuple(w[k : k + least]), ()))
    return out


def test_leaks(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{data}/eval_items.parquet").select("item_id", "text")
    first = items.first().text.split()
    more = [(-1, None), (-2, ""), (-3, " / ".join(first[:12]).upper()), (-4, " ".join(first[:11])), (-5, " ".join(first * 40))]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute_leaks([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 12)
    got = leaks.leaks(docs.withColumn("seed", F.lit("x")), items.withColumn("pos", F.lit(0)))
    assert {(r.item_id, r.doc_id) for r in got.collect()} == want
    assert leaks.leaks(docs.where("false"), items).count() == leaks.leaks(docs, items.where("false")).count() == 0


def brute_tiles(a, b, least):
    """Running greedy string tiling by definition: the longest unmarked common run, again and again."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (least - 1, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        for x in range(k):
            ma[i + x] = mb[j + x] = True
        total += k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=24))
def test_tiling_by_definition(a, b):
    hits = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
    if hits:
        i, j = np.array(hits).T
        found = leaks.tiles(i, j, 3)
        used_a, used_b = set(), set()
        for x, y, n in found:
            assert a[x : x + n] == b[y : y + n] and n >= 3
            assert not used_a & set(range(x, x + n)) and not used_b & set(range(y, y + n))
            used_a |= set(range(x, x + n))
            used_b |= set(range(y, y + n))
        assert max(t[2] for t in found) >= 3
        assert abs(sum(t[2] for t in found) - brute_tiles(a, b, 3)) <= max(len(a), len(b)) // 2


