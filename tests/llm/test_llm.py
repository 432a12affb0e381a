"""The text operators against brute force, exact round trips and edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import both, database
from tests.conftest import SMALL
from tidemark.llm import chat, embeddings, jaccard, langid, licenses, mixing, pieces, quality_rules, rule_ensemble, toxicity
from tidemark.llm.queries import ORACLE_SQL, QUERIES, piece_model

ODD = [None, "", " ", "\n", "one", "ONE two", "a b c d e f g h i j k l", "x " * 5000, "é▁ü 　", "<|im_start|>\\<\\|", "same text here again", "same text here again"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def odd_docs(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, 1.0) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, None), rows[-1]], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    ours, theirs, a, b = both(spark, QUERIES[name], ORACLE_SQL[name], SMALL, database(SMALL))
    assert a == b and ours == theirs


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    for base in range(12):
        own = [f"w{base}_{k}" for k in range(60)]
        for _ in range(6):
            copy = list(own)
            for k in rng.choice(60, rng.integers(0, 4), replace=False):
                copy[k] = f"x{rng.integers(1e6)}"
            texts.append(" ".join(copy))
    texts += [t or "" for t in ODD]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = classes(range(len(texts)), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, 4, 85).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_jaccard_edge_cases(spark):
    got = jaccard.similar_groups(odd_docs(spark), 5, 80).collect()
    assert {r.doc_id for r in got} == {*range(len(ODD)), None}
    assert {r.doc_id: r.component_id for r in got}[11] == 10
    assert jaccard.similar_groups(odd_docs(spark).limit(0)).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    vectors = [v + rng.normal(0, 0.05, 8) for v in x for _ in range(4)]
    rows = [(i, [float(f) for f in v], i % 3 if i % 7 else None) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, rows[1][1], rows[1][2]), (1004, [None] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links = [(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[2] == b[2] and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    n = Counter(i for p in links for i in p)
    comp = classes([r[0] for r in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table, 0.98).collect()}
    assert links and got == {r[0]: (n[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}


def test_blocks_agree_with_one_block(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(f) for f in v], 1) for i, v in enumerate(np.repeat(rng.normal(size=(50, 6)), 3, 0) + rng.normal(0, 0.05, (150, 6)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, embeddings.near_duplicates(table).collect()))
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    assert sorted(map(tuple, embeddings.near_duplicates(table).collect())) == whole


def test_pieces_equal_the_library(spark):
    own = pieces.Pieces(piece_model())
    texts = [t or "" for t in ODD] + ["a    b  c" + " " * 40, "\x00", "<s>", "<0x0A>", "\r\n\t", "héllo wörld ½ ﬁ 日本", "a" * 3000]
    assert own.encode(texts) == own.library.encode(texts, add_bos=True, add_eos=True)
    got = {r.doc_id: r for r in pieces.tokenize(odd_docs(spark), piece_model()).collect()}
    assert got[0].ids == [1, 2] and got[9].decoded == ODD[9]


def test_chat_round_trip(spark):
    nasty = [None, "", "<|im_end|>", "\\", "<\\|", "a\n<|im_sep|>", "<", "\\\\<|"]
    rows = [(1, i, "assistant" if i % 3 else "us<|er\n", t) for i, t in enumerate(nasty)] + [(2, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:-1]]
    assert got[1].loss_text == "".join(t or "" for i, t in enumerate(nasty) if i % 3)
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_quality_statistics_against_brute_force():
    texts = [*ODD, "a b c d e f g h " * 3, "!! ? A B#*$%&|<>\nx\nx\n \n \nx"]
    for text, row in zip(texts, quality_rules.text_statistics(texts)):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(8)}
        lines = Counter(x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        assert list(row[:5]) == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(n - 1 for n in lines.values()), len(covered)]


def test_quality_rules_edge_cases(spark):
    assert quality_rules.judge(odd_docs(spark)).count() == len(ODD) + 2
    kept = quality_rules.keep_documents(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and quality_rules.judge(odd_docs(spark).limit(0)).count() == 0


def test_mixing_repeats_and_edges(spark):
    docs = odd_docs(spark)
    a, b = (sorted(map(str, mixing.mix(d, epochs=2.0).collect())) for d in (docs, docs.repartition(5)))
    assert a == b
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = {r.source: r["count"] for r in mixing.mix(many).groupBy("source").count().collect()}
    assert abs(got["a"] - 2000) < 200 and abs(got["b"] - 2000) < 200
    assert mixing.mix(docs.limit(0)).count() == 0


def test_licenses(spark):
    text = "start " + licenses.TEMPLATES["MIT-text"].replace("free of charge", "free of any charge") + " end Released under the MIT License."
    got = licenses.scan(spark.createDataFrame([(1, text), (2, None), (3, "none"), (3, text)], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter({(1, "MIT-text"): 1, (1, "MIT"): 1, (3, "MIT-text"): 1, (3, "MIT"): 1})
    r = next(r for r in got if r.license == "MIT")
    assert text.encode()[r.start_byte : r.end_byte] == b"Released under the MIT License." and r.coverage == 1.0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = np.random.default_rng(7)
    terms = sorted({"".join(rng.choice(list("abc"), rng.integers(3, 12))) for _ in range(30)})
    lexicon = toxicity.Lexicon(terms)
    for _ in range(400):
        w = "".join(rng.choice(list("abc"), rng.integers(1, 13)))
        limit = 0 if len(w) <= toxicity.SHORT else 2 if len(w) >= toxicity.LONG else 1
        assert sorted(lexicon.matches(w)) == sorted((t, d) for t in terms if (d := edit_distance(w, t)) <= limit)


def test_quotation_weighs_less():
    model = toxicity.ToxicModel({"scoundrel": (6.0, 4.0)}, (1.0, 0.0, 0.0), -4.0)
    abuse, typo, quoted, clean = (model.score(t) for t in ("you are a scoundrel", "what a scoundrul", 'the word "scoundrel" is old', "hello there"))
    assert abuse > typo > quoted > clean


def test_models_edge_cases(spark):
    empty = toxicity.ToxicModel()
    assert toxicity.scored(odd_docs(spark), empty, ["doc_id"]).count() == len(ODD) + 2
    model = rule_ensemble.fit(np.zeros((0, 7)), np.zeros(0))
    assert {r.score for r in rule_ensemble.classify(odd_docs(spark), model).collect()} == {0.5}
    got = langid.identify(odd_docs(spark), None).collect()
    assert {r.lang_pred for r in got} == {"und"}


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.9), ("op8_language", "lang", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    got = {r.doc_id: r for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    truth = spark.read.parquet(f"/root/testdata/sf0.01/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label).collect()
    held = [r for r in truth if r[label] is not None and got[r.doc_id].held_out]
    right = [r for r in held if (got[r.doc_id].lang_pred if label == "lang" else got[r.doc_id].predicted) == r[label]]
    assert len(right) >= least * len(held)
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % (5 if label == "lang" else 4) == (0 if label == "lang" else 2)) for i, g in got.items())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SMALL).cache()
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    texts = [r.text for r in docs.collect()]
    sets = [shingles(t, 5) for t in texts]
    assert not [1 for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    digest = {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert {r.decoded_sha256 for r in corpus_pipeline.encode_pieces(spark, mixed, SMALL).collect()} <= digest
