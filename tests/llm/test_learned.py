"""The operators that judge: repair of entered values, names, languages; held-out accuracy and edges."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import edits, languages, names, reference_values


def brute_distance(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


words = st.text(alphabet="abc", max_size=7)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 3))
def test_distance_and_variants(a, b, k):
    d = brute_distance(a, b)
    assert edits.distance(a, b, k) == min(d, k + 1)
    if d <= k:
        assert edits.variants(a, k) & edits.variants(b, k)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdef", min_size=22, max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 19)), max_size=3))
def test_long_words_share_a_part(a, slips):
    b = a
    for kind, i in slips:
        b = b[:i] + (b[i + 1] + b[i] if kind == 0 else b[i] if kind == 1 else b[i : i + 2] + "x") + b[i + 2 :]
    k = brute_distance(a, b)
    assert edits.distance(a, b, 3) == min(4, k)
    if 0 < k <= 3:
        assert edits.segments(a, k) & edits.segments(b, k)


def test_near_against_all_pairs(spark):
    rng = random.Random(3)
    some = lambda: spark.createDataFrame([("".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))),) for _ in range(60)] + [(None,)], "word string")
    left, right = some(), some()
    allowed = lambda n: F.when(n < 5, 0).when(n < 8, 1).otherwise(2)
    most = lambda n: 0 if n < 5 else 1 if n < 8 else 2
    got = {(r.a, r.b, r.d) for r in edits.near(left, right, allowed).collect()}
    ls, rs = ({r.word for r in x.collect() if r.word} for x in (left, right))
    assert got == {(a, b, brute_distance(a, b)) for a in ls for b in rs if brute_distance(a, b) <= most(max(len(a), len(b)))}


# 6


@pytest.fixture(scope="module")
def reference(spark, data):
    return spark.read.parquet(f"{data}/ref_values.parquet")


def written_values(spark, *values):
    return spark.createDataFrame([("relation", v, i) for i, v in enumerate(values)], "list_name string, written string, text int")


def test_entered_values(spark, reference):
    cases = {
        "USES": "uses", "(uses)": "uses", "us​es": "uses", "apparently  runs out of,": "located_in", "breaksinthrough-peranalyst": "exploits", "delivers [2]": "delivers", "StationedIn–PerAnalyst": "located_in", "with contained": "mitigated_by",
        "Seen alnogside": "associated_with", "beelved_work_of": "attributed_to", "???": "unmatched", "": "unmatched", "lunch menu": "unmatched", "see figure 3": "unmatched", "x" * 20_000: "unmatched",
    }
    got = {r.written: r.entry for r in reference_values.mapped(written_values(spark, *cases, None), reference, ["text"]).collect()}
    assert got == cases


def test_entered_repeats_and_empty(spark, reference):
    rows = written_values(spark, *["Uses"] * 50, "todo")
    assert reference_values.mapped(rows, reference, ["text"]).count() == 51
    assert reference_values.mapped(rows.where("false"), reference, ["text"]).count() == 0
    assert {r.entry for r in reference_values.mapped(rows, reference.where("false"), ["text"]).collect()} == {"unmatched"}


def test_held_out_slips(spark, reference):
    """Forms with one or two random slips come back; 0.97 at least."""
    rng = random.Random(11)
    forms = [(r.form, r.entry) for r in reference.where("list_name = 'relation'").collect()]
    cases = {}
    for form, entry in forms * 6:
        text = list(form)
        for _ in range(1 if len(form) < 9 else 2):
            i = rng.randrange(len(text) - 1)
            kind = rng.randrange(3)
            text[i : i + 2] = [text[i + 1], text[i]] if kind == 0 else [text[i]] if kind == 1 else [text[i], rng.choice("etaoin"), text[i + 1]]
        cases["".join(text)] = entry
    got = {r.written: r.entry for r in reference_values.mapped(written_values(spark, *cases), reference, ["text"]).collect()}
    assert sum(got[k] == v for k, v in cases.items()) >= 0.97 * len(cases)


# 7


def groups_of(spark, *spellings):
    df = spark.createDataFrame([(s, n) for s, n in spellings], "name string, n long")
    by = {}
    for r in names.entities_of(df).collect():
        by.setdefault(r.entity, set()).add(r.name)
    return sorted(by.values(), key=lambda s: sorted(s))


def test_names(spark):
    fox = [("Elizabeth Zikcojepimum", 9), ("E Zikcojepiumm", 2), ("Liz Zikcojenimum", 3), ("Zikcojepimum, Elizabeth", 4), (" ELIZABETH ZIKCOJEPIMUM.", 1), ("Beth Zikcojepimum", 1)]
    other = [("Thomas Zikcojepimum", 5), ("Tom Zikcojepimum", 2)]
    bank = [("Vumtarsolin Savings Bank Company", 5), ("Savings Bank Co., Vumtarsolin", 2), ("the vumtarsolin savnigs bank", 1), ("Vumtarsolin SavingsBank Company", 1)]
    mine = [("Vumtarsolin Mining Limited", 5)]
    got = groups_of(spark, *fox, *other, *bank, *mine, (None, 3), ("N/A", 4), (" ", 1), ("-", 2))
    assert got == sorted([{n for n, _ in g} for g in (fox, other, bank, mine)], key=lambda s: sorted(s))


def test_names_edges(spark):
    assert groups_of(spark, ("!!!", 1), ("???", 1), ("x" * 3000, 1)) == [{"!!!"}, {"???"}, {"x" * 3000}]
    empty = spark.createDataFrame([], "name string, n long")
    assert names.entities_of(empty).count() == 0


def slip(rng, word):
    """``word`` with one random slip after its first letter."""
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i + 1 :], word[: i + 1] + rng.choice("etaoin") + word[i + 1 :]])


def filler(rng, n):
    """Names of other organisations of the same trades, two spellings each."""
    out = []
    for _ in range(n // 2):
        name = "".join(rng.choice("bdfgjkpqvwxyz") + rng.choice("aeiou") for _ in range(6)).capitalize() + " " + rng.choice(["Cement", "Shipyards", "Mining"])
        out += [(name + " Limited", 2), (name + " Ltd", 1)]
    return out


@pytest.mark.parametrize("others", [0, 3000])
def test_hot_name(spark, others):
    """A name of thousands of spellings keeps its distinctive token, beside few names and many."""
    rng = random.Random(5)
    sure = {"Vumtarsolin Cementing Limited", "Vumtarsolin Cementing Ltd", "Cementing, Vumtarsolin", "the Vumtarsolin Cementing Co."}
    hot = set(sure)
    while len(hot) < 3000:
        words = [slip(rng, w) if rng.random() < 0.5 else w for w in ("vumtarsolin", "cementing", rng.choice(["limited", "holdings", "corporation"]))] + rng.sample(["the", "of", "and", "de", "group", "intl"], rng.randrange(3))
        rng.shuffle(words)
        hot.add(" ".join(words))
    got = groups_of(spark, *[(n, 1) for n in sorted(hot)], *filler(rng, others))
    most = max((g & hot for g in got), key=len)
    assert sure <= most and len(most) >= 0.97 * len(hot)
    assert not any(g & hot and g - hot for g in got)


def test_short_names(spark):
    """Distinctive tokens of 3 to 6 letters: slips, initials and legal forms."""
    want = []
    for name, wrong in [("Ford", "Frod"), ("Intel", "Intle"), ("Nestle", "Nesle"), ("Sony", "Snoy"), ("Bosch", "Boshc"), ("Hitach", "Hitahc")]:
        want.append({f"{name} {x}" for x in ("Optics Corporation", "Optics Corp", "Optics", "Optics Ltd", "Optics Holdings")} | {f"{wrong} Optics Inc"})
    want += [{f"{name} {x}" for x in ("Optics Corporation", "Optics Corp", "Optics", "Optics Ltd")} for name in ("IBM", "KLM")]
    want.append({"Robert Smith", "Bob Smith", "Smith, Robert", "R. Smith", "Robert Smith Jr", "Robert Smyth"} - {"Robert Smith Jr"})
    want.append({"Thomas Hart", "Tom Hart", "T. Hart", "Hart, Thomas"})
    want.append({"Margaret Lee", "Peggy Lee", "M. Lee"})
    got = groups_of(spark, *[(n, 1) for g in want for n in g])
    assert got == sorted(want, key=lambda s: sorted(s))


def test_short_names_of_their_own(spark):
    """A short name that many spellings hold is not a slip of a near one, however frequent that is."""
    rng = random.Random(8)
    side = ["".join(rng.choice("bdfgkmprtvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(12)]
    smith, smyth = {f"Robert Smith {s}" for s in side}, {f"Robert Smyth {s}" for s in side}
    assert not any(g & smith and g & smyth for g in groups_of(spark, *[(n, 1) for n in smith | smyth]))


def test_initials_in_their_order(spark):
    """The first initial is the given name's, whatever the other names are; equals stay apart."""
    want = [{"Robert Halvorsen", "R. A. Halvorsen", "Halvorsen, R."}, {"Andrew Halvorsen", "A. Halvorsen", "A. R. Halvorsen"}]
    assert groups_of(spark, *[(n, 10 if n == "Robert Halvorsen" else 12 if n == "Andrew Halvorsen" else 1) for g in want for n in g]) == sorted(want, key=lambda s: sorted(s))
    got = groups_of(spark, ("Robert Halvorsen", 5), ("Richard Halvorsen", 5), ("R. Halvorsen", 1), ("Halvorsen", 1))
    assert sorted(map(len, got)) == [1, 1, 1, 1]


def test_dropped_words_and_bare_names(spark):
    """A rare name that lacks a word of a far more frequent one is it; a bare one if hardly any other is."""
    got = groups_of(spark, ("Vumtarsolin Savings Bank", 2000), ("Vumtarsolin Savings", 1), ("Vumtarsolin", 1), ("Vumtarsolin Mining", 3))
    assert got == sorted([{"Vumtarsolin Savings Bank", "Vumtarsolin Savings", "Vumtarsolin"}, {"Vumtarsolin Mining"}], key=lambda s: sorted(s))
    got = groups_of(spark, ("Vumtarsolin Savings Bank", 20), ("Vumtarsolin Savings", 10), ("Vumtarsolin", 1))
    assert sorted(map(len, got)) == [1, 1, 1]


def test_chains_of_slips(spark):
    """A slip of a slip of a slip ends where its chain does."""
    chain = ["vumtarsolinbek", "vumtarsolinbekxx", "vumtarsolinbekxxyy", "vumtarsolinbekxxyyzz", "vumtarsolinbekxxyyzzww", "vumtarsolinbekxxyyzzwwvv"]
    got = groups_of(spark, *[(f"{w} Mining {x}", 1) for i, w in enumerate(chain) for x in ["Limited", "Ltd", "Corp", "Company", "Co", "Inc", "Group"][i:]])
    assert len(got) == 1


def test_ten_times_the_table(spark):
    """The same links in a table and in ten renamed copies of it."""
    letters = "bcdfghjklmnpqrstvwxz"
    base = [("Robert Halvorsenik", 4), ("Bob Halvorsenik", 1), ("R. Halvorsenik", 1), ("Robert Halvorsneik", 1), ("Zikcojepimum Mining Limited", 6), ("Mining Zikcojepimum Ltd", 1), ("Zikcojepimun Mining", 1)]
    renamed = lambda name, k: name.replace("Halvors", "Halvors" + letters[k] * 3).replace("cojepi", letters[k] * 3 + "cojepi")
    one = groups_of(spark, *base)
    ten = groups_of(spark, *[(renamed(n, 2 * k), c) for k in range(10) for n, c in base])
    assert ten == sorted([{renamed(n, 2 * k) for n in g} for k in range(10) for g in one], key=lambda s: sorted(s)) and len(one) == 2


def test_names_in_tables_of_two_sizes(spark):
    rng = random.Random(6)
    mine = ["Walter Vumtarsolin", "W. Vumtarsolin", "Vumtarsolin, Walter", "Walter Vumtarsloin", "Zikcojepimum Shipyards Limited", "Zikcojepimum Shipyards", "Shipyards Zikcojepimum Ltd", "Zikcojepimmu Shipyards Ltd"] + [f"Walter Vumtarsolin {'x' * 30}{i}" for i in range(12)]
    few, many = ({frozenset(g & set(mine)) for g in groups_of(spark, *[(n, 1) for n in mine], *filler(rng, n)) if g & set(mine)} for n in (0, 4000))
    assert few == many and frozenset(mine[:4]) in few and frozenset(mine[4:8]) in few


def test_name_pairs(spark, data):
    ents, triples = spark.read.parquet(f"{data}/entities.parquet"), spark.read.parquet(f"{data}/triples.parquet")
    pairs = {tuple(r) for r in names.same_names(ents, triples).collect()}
    assert pairs and all(a < b for a, b in pairs)
    a = names.names_of(ents, triples).where("trim(lower(name)) in ('n/a', 'unknown', '-', '')")
    placeholders = {r.name for r in a.collect()}
    assert not {x for p in pairs for x in p} & placeholders


# 10


@pytest.fixture(scope="module")
def model(spark, data):
    return languages.fit(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet"))


SAMPLES = {
    "en": "The visitors left their umbrellas near the door and walked slowly through the empty museum before lunch.",
    "de": "Die Besucher ließen ihre Schirme an der Tür stehen und gingen vor dem Mittagessen langsam durch das leere Museum.",
    "fr": "Les visiteurs ont laissé leurs parapluies près de la porte et ont traversé lentement le musée vide avant le déjeuner.",
    "es": "Los visitantes dejaron sus paraguas cerca de la puerta y caminaron despacio por el museo vacío antes de la comida.",
    "it": "I visitatori hanno lasciato gli ombrelli vicino alla porta e hanno attraversato lentamente il museo vuoto prima di pranzo.",
    "ru": "Посетители оставили свои зонты у двери и медленно прошли через пустой музей перед обедом.",
}


def test_unseen_sentences(model):
    for lang, text in SAMPLES.items():
        (found,) = languages.segments([text], *model)
        assert [languages.LANGUAGES[s[2]] for s in found] == [lang] and found[0][3] > 0.5


def test_mixed_text_and_offsets(model):
    text = f"{SAMPLES['en']} {SAMPLES['en']}\n\n10:55\t203.0.113.33\t22\t382e62494fbe0b2c\n\n{SAMPLES['de']} {SAMPLES['de']}\n{SAMPLES['ru']}"
    (found,) = languages.segments([text], *model)
    assert [languages.LANGUAGES[s[2]] for s in found] == ["en", "de", "ru"]
    assert text[found[1][0] : found[1][1]] == f"{SAMPLES['de']} {SAMPLES['de']}"
    assert found[0][4] == 2 * len(SAMPLES["en"]) + 1


def test_texts_without_language(model):
    assert languages.segments([None, "", " \n", "f8dcdbddd2d34c7c\n10.0.0.1 443", "🔥🔥"], *model) == [[]] * 5


def test_held_out_labels(spark, data):
    """Documents outside the sample agree with their label; wrong labels are a small part."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = languages.held(docs).where("main").select("doc_id", "label", "lang").where(F.col("label").isin(languages.LANGUAGES)).collect()
    assert sum(r.label == r.lang for r in got) >= 0.9 * len(got)


def test_language_edges(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text")
    extra = spark.createDataFrame([(-1, "EN-x", SAMPLES["en"]), (-2, "und", SAMPLES["en"]), (-3, None, None), (-4, "en", "x" * 100_000), (-5, "de", (SAMPLES["de"] + " ") * 2 + (SAMPLES["fr"] + " ") * 2)], "doc_id long, lang string, text string")
    both = docs.unionByName(extra).withColumn("segments", F.lit(0))
    got = {(r.doc_id, r.lang) for r in languages.mislabelled(both).where("doc_id < 0").collect()}
    assert got == {(-2, "en"), (-5, "de"), (-5, "fr")}
    assert languages.mislabelled(both.where("false")).count() == 0
