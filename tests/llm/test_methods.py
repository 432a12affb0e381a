"""The methods inside the text operators against plain versions, and their odd inputs."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.test_llm import classes, edit_distance, odd_docs, shingles
from tidemark.llm import chat, embeddings, jaccard, langid, licenses, mixing, pieces, quality_rules, rule_ensemble, toxicity
from tidemark.llm.queries import QUERIES, piece_model

LARGE = "/root/testdata/sf0.1"


# --- embeddings -------------------------------------------------------------------------------------------------------
def planted(seed=8, dim=64):
    """Two labels of some hundred groups with links at the threshold, copies, a third of all rows in one tight group, and odd rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in (1, 2):
        for c in rng.normal(size=(60, dim)):
            rows += [(c + rng.normal(0, s, dim), label) for s in (0.0, 0.05, 0.1, 0.14, 0.16)]
        hot = rng.normal(size=dim)
        rows += [(hot + rng.normal(0, 0.01, dim), label) for _ in range(120)] + [(hot, label)] * 30
    table = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(table)
    table += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * dim, 1), (n + 3, [1e200] * dim, 1), (n + 4, [float("inf")] + [1.0] * (dim - 1), 1), (n + 5, [1.0] * 3, 1), (n + 6, [2.0] * 3, 1), (n + 7, table[0][1], None), (0, table[0][1], 1)]
    return table


def brute(table, cosine=0.98):
    ok = [r for r in dict.fromkeys((i, tuple(v or ()), k) for i, v, k in table) if r[1] and r[2] is not None and np.isfinite(r[1]).all() and 0 < sum(x * x for x in r[1]) < np.inf]
    links = []
    for label in {r[2] for r in ok}:
        for size in {len(r[1]) for r in ok if r[2] == label}:
            own = [r for r in ok if r[2] == label and len(r[1]) == size]
            x = np.array([r[1] for r in own])
            x /= np.linalg.norm(x, axis=1)[:, None]
            links += [(own[i][0], own[j][0]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True)]
    n = Counter(i for p in links for i in p)
    comp = classes([r[0] for r in table], links)
    return {i: (n[i], comp[i], comp[i] == i) for i in comp}


@pytest.mark.parametrize(("block", "pivots"), [(2048, 32), (64, 4), (24, 3)])
def test_embeddings_of_several_levels(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PIVOTS", pivots)
    monkeypatch.setattr(embeddings, "DEALT", 100)
    table = planted()
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    want = brute(table)
    assert sum(v[0] for v in want.values()) > 20_000 and got == want


def test_embeddings_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embeddings.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], None), (2, [1.0, None], 1)], empty.schema)
    assert {(r.vec_id, r.n_links) for r in embeddings.near_duplicates(odd).collect()} == {(None, 0), (1, 0), (2, 0)}


# --- n-gram join ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("part", [1024, 8])
def test_long_posting_lists(spark, monkeypatch, part):
    for name in ("LIST_PART", "JOIN_PART", "HUB_PART"):
        monkeypatch.setattr(jaccard, name, part)
    rng = np.random.default_rng(9)
    common = [f"c{k}" for k in range(30)]
    texts = []
    for base in range(40):  # unrelated documents that share a passage, and groups of near copies
        own = common + [f"w{base}_{k}" for k in range(rng.integers(3, 40))]
        for _ in range(rng.integers(1, 7)):
            copy = list(own)
            copy[int(rng.integers(len(copy)))] = f"x{rng.integers(1e9)}"
            texts.append(" ".join(copy))
    texts += [" ".join(common)] * 9
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = classes(range(len(texts)), links)
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs, 4, 80).collect()}
    assert links and got == want


def test_one_id_with_several_texts_joins_their_groups(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(20)) for c in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b), (9, None), (7, "alone")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, 4, 85).collect()}
    assert got == {5: (17, 3), 3: (17, 3), 9: (17, 3), 7: (1, 7)}


def test_counters_do_not_saturate():
    counts = np.zeros(jaccard.SKETCH_ROW, np.int64)
    counts[[0, 1, 2, 3]] = [255, 256, 10**12, 2**50]
    assert (jaccard._unpack(jaccard._pack(counts)) == counts).all()
    ranks = np.round(jaccard.RANK_STEPS * np.log2(1.0 + counts)).astype(np.uint16)
    assert list(np.argsort(ranks[:4])) == [0, 1, 2, 3] and ranks[2] < ranks[3]
    assert jaccard._salts(np.zeros(10, np.uint16)).max() > 1 and jaccard._salts(np.full(10, 100, np.uint16))[100] == 0


# --- toxicity ---------------------------------------------------------------------------------------------------------
def test_toxic_weights_against_a_direct_scan():
    rng = np.random.default_rng(10)
    terms = {"".join(rng.choice(list("abcd"), rng.integers(3, 12))): (float(rng.uniform(3, 8)), float(rng.uniform(0, 3))) for _ in range(25)}
    stems = {"abca": 2.5, "dcbad": 4.0}
    model = toxicity.ToxicModel(terms, (1.0, 0.5, 0.5, 0.1), -5.0, stems)
    for _ in range(500):
        word = "".join(rng.choice(list("abcd"), rng.integers(2, 14)))
        direct = [w for s, w in stems.items() if word.startswith(s)]
        for term, (exact, near) in terms.items():
            d = edit_distance(word, term)
            if d == 0 or (near > 0 and d <= toxicity.allowed(term)):
                direct.append(exact if d == 0 else near)
        assert model.weight(word) == max(direct, default=0.0), word


def test_quotations_are_spans():
    model = toxicity.ToxicModel({"scoundrel": (6.0, 4.0)}, (1.0,), -4.0)
    one = lambda text: model.features(text)
    inside = ['he is, he claimed, "a very old and tired scoundrel of the worst kind" indeed', "« le scoundrel » ici", "„der scoundrel“ hier", "“no scoundrel here”", "a 'true scoundrel' he is"]
    outside = ['"one" scoundrel "two"', 'scoundrel "', "don't be a scoundrel, it's bad", '"open\nscoundrel"', "scoundrel"]
    assert all(one(t)[4] == 6.0 and one(t)[0] == pytest.approx(6.0 * toxicity.QUOTED) for t in inside)
    assert all(one(t)[4] == 0.0 and one(t)[0] == 6.0 for t in outside)
    assert one("they said scoundrel")[5] == 6.0 and one("you scoundrel")[6] == 6.0 and one("you scoundrel")[0] > 6.0


def test_toxic_copies_and_stems(spark):
    rng = np.random.default_rng(11)
    filler = lambda: " ".join(f"w{rng.integers(400)}" for _ in range(30))
    toxic = [f"{filler()} badstem{chr(97 + i % 20)}{chr(97 + i % 13)} {filler()}" for i in range(60)]
    copied = filler() + " badstemzz unluckyword " + filler()
    rows = [(i, t, 1) for i, t in enumerate(toxic + [copied] * 60)] + [(1000 + i, filler(), 0) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    once = toxicity.train(frame, frame, "toxic", copies_once=True)
    assert "unluckyword" in toxicity.train(frame, frame, "toxic").terms and "unluckyword" not in once.terms
    assert any(s.startswith("bads") for s in once.stems) and once.score(filler() + " badstemqq") > 0.3 > once.score(filler())


def test_toxicity_of_one_class_and_nothing(spark):
    frame = spark.createDataFrame([(1, "a", 0), (1, "b", None), (None, "c", 1), (2, None, 0)], "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame, "toxic")
    assert not model.terms and model.score("anything") < 0.5
    assert toxicity.scored(odd_docs(spark).limit(0), model, ["doc_id"]).count() == 0
    long = "filler " * 400_000 + "scoundrel"
    assert toxicity.ToxicModel({"scoundrel": (6.0, 4.0)}, (1.0,), -4.0).score(long) > 0.5


def test_held_out_toxicity(spark):
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, LARGE).collect()}
    truth = spark.read.parquet(f"{LARGE}/labels.parquet").where("toxic IS NOT NULL").collect()
    held = [(r.toxic, got[r.doc_id].predicted) for r in truth if got[r.doc_id].held_out]
    caught = [p for t, p in held if t]
    assert sum(caught) >= 0.9 * len(caught) and sum(p for t, p in held if not t) <= 0.01 * len(held)
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, g in got.items())


# --- quality classifier -----------------------------------------------------------------------------------------------
def test_rules_as_columns_equal_rules_in_numpy(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, len(rule_ensemble.FEATURES))).round(1)
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    model = rule_ensemble.fit(x, y)
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"{n} double" for n in rule_ensemble.FEATURES))
    got = np.array([r.s for r in frame.select("i", model.score().alias("s")).orderBy("i").collect()])
    z = model.intercept + sum(w * rule_ensemble.holds(rule, x) for rule, w in zip(model.rules, model.weights, strict=True))
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == (y == 1)).mean() > 0.95


def test_quality_classifier_odd_inputs(spark):
    empty = odd_docs(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = rule_ensemble.train(empty, labels, "quality")
    assert rule_ensemble.classify(empty, model).count() == 0
    one = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (3, 1)], labels.schema)
    scores = {r.doc_id: r.score for r in rule_ensemble.classify(odd_docs(spark), rule_ensemble.train(odd_docs(spark), one, "quality")).collect()}
    assert len(set(scores.values())) == 1 and all(0.5 < s < 1 for s in scores.values())


# --- language ---------------------------------------------------------------------------------------------------------
def test_gradients_and_pooling_against_plain_versions():
    net = langid.ByteNet(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(13)
    x, y = rng.integers(97, 110, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    pooled = net.pooled(x)
    for i in range(4):
        want = []
        for w in langid.WIDTHS:
            e = net.p["embed"][x[i]]
            z = np.array([e[s : s + w].reshape(-1) @ net.p[f"w{w}"] for s in range(langid.WINDOW - w + 1)])
            want += list(np.maximum(z.max(0) + net.p[f"b{w}"], 0))
        assert np.allclose(pooled[i], want)

    def loss():
        return -np.log(net.probabilities(x)[np.arange(4), y]).mean()

    grads = net.gradients(x, y)
    for name in ("out", "bias", "w3", "b2", "embed"):
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        for k in rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 3):
            keep = flat[k]
            flat[k] = keep + 1e-5
            up = loss()
            flat[k] = keep - 1e-5
            down = loss()
            flat[k] = keep
            assert (up - down) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-6)


@pytest.mark.parametrize(("text", "known"), [("½ ²", False), ("12 _ 3", False), ("", False), ("٣", False), ("½ x", True), ("日本", True), ("é", True)])
def test_letters(text, known):
    assert langid.has_letter(text) is known


def test_language_training_odd_inputs(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.train(spark.createDataFrame([], schema)) is None
    one = langid.train(spark.createDataFrame([(1, "hello there", "en"), (None, "more", "en"), (2, None, "fr"), (3, "x", None)], schema))
    assert one.languages == ["en"]
    many = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(5)], schema)
    with pytest.raises(ValueError):
        langid.train(many, max_languages=4)


# --- licenses ---------------------------------------------------------------------------------------------------------
def test_altered_license_texts_are_found(spark):
    rng = np.random.default_rng(14)
    rows, want = [], set()
    for name, text in (licenses.TEMPLATES | licenses.FULL_TEXTS).items():
        for k in range(6):
            words = text.split()
            for _ in range(int(rng.integers(0, max(1, int(0.12 * len(words))) + 1))):
                at = int(rng.integers(len(words)))
                change = rng.integers(3)
                words[at : at + 1] = [] if change == 0 else [words[at], "inserted"] if change == 1 else ["changed"]
            filler = " ".join(f"w{rng.integers(99)}" for _ in range(30))
            rows.append((len(rows), f"{filler} {' '.join(words)} {filler}"))
            want.add((len(rows) - 1, name))
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want & found) >= 0.97 * len(want)


def test_license_rows_against_plain_containment(spark):
    got = {}
    for r in licenses.scan(spark.read.parquet(f"{SMALL}/documents.parquet")).where("coverage = 1").collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        plain = licenses.brute_force(licenses.TEMPLATES, r.text or "")
        assert plain <= got.get(r.doc_id, set()) | {"Apache-2.0"}


def test_licenses_odd_inputs(spark):
    docs = odd_docs(spark)
    assert licenses.scan(docs, {}).count() == 0 and licenses.scan(docs, {"empty": " "}).count() == 0 and licenses.scan(docs.limit(0)).count() == 0
    got = licenses.scan(spark.createDataFrame([(1, "say one two now"), (2, "w " * 300_000 + licenses.TEMPLATES["MIT"])], "doc_id long, text string"), {"short": "one two", "MIT": licenses.TEMPLATES["MIT"]}).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "short"), (2, "MIT")}


# --- mixing, chat, pieces, quality rules ------------------------------------------------------------------------------
def test_weights_and_many_sources(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.element_at(F.lit(["a", "b", None]), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.lit(1).alias("rate"), F.lit(2).alias("mix_copy"))
    got = {r.source: r["count"] for r in mixing.mix(docs, {"a": 3.0, None: 1.0, "b": 0.0, "absent": 0.0}).groupBy("source").count().collect()}
    assert abs(got["a"] - 2250) < 200 and abs(got[None] - 750) < 120 and "b" not in got
    hot = mixing.mix(docs, {"a": 1.0}, epochs=10.0)
    assert abs(hot.count() - 30_000) < 900  # a rate of 30: above the largest single draw
    few = sorted((r.mix_key, r.doc_id) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 1)
    assert sorted((r.mix_key, r.doc_id) for r in mixing.mix(docs).collect()) == few


def test_ties_are_ordered_before_escaping(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "<z"), (1, 1, "assistant", "<|"), (1, 0, "a\\b", "q")], "conv_id long, turn long, role string, text string")
    read = chat.read_chats(chat.format_chats(turns)).first()
    assert [t.text for t in read.turns] == ["q", "<z", "<|"] == [t for _, _, t in sorted([(0, "a\\b", "q"), (1, "assistant", "<z"), (1, "assistant", "<|")])]
    assert chat.read_chats(chat.format_chats(turns, loss_role="a\\b")).first().loss_text == "q"


def test_pieces_of_nothing(spark):
    assert pieces.tokenize(odd_docs(spark).limit(0), piece_model(), digests_only=True).count() == 0


def test_fences_of_small_and_nameless_groups(spark):
    plain = " ".join(f"word{k}" for k in range(40))
    loud = " ".join(f"word{k}!!!!!" for k in range(40))
    rows = [(i, plain, None if i % 2 else "en", None) for i in range(200)] + [(900, loud, None, None), (901, loud, "xx", "rare"), (902, plain, "xx", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert kept[0] and kept[1] and kept[902] and not kept[900] and not kept[901]


def test_pipeline_runs_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    plain = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(plain)] + [(100, plain[0], None, None, None), (None, plain[1] + " more", "en", "s", 1), (101, None, "en", "s", 0), (102, "", None, "s", 0), (101, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i == 0)) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for name, d in (("some", docs), ("none", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.select("doc_id").distinct().count() <= 31
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_words_of_odd_texts():
    assert toxicity.words_of(None) == (set(), set()) and toxicity.words_of("")[0] == set()
