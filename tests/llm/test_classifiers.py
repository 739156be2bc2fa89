"""Toxicity grammar, compression classifier and pipeline: held-out accuracy, special cases, brute force."""

import zlib

import pytest

import corpus_pipeline
from tidemark.llm import common, compression_quality, decontamination, near_dedup, quality_rules, toxicity

DATA = "/root/testdata/sf0.01"


def test_composed_machine_weighs_context():
    grammar = toxicity.Grammar({})
    one = lambda text: grammar.measure(text)[1]
    plain = one("what an idiot")
    assert one("you idiot") > plain > one("he said that an idiot won") > 0
    assert one("he is not an idiot") < one("he is an idiot")
    assert one("i will kill you") > one("they kill time")
    assert one("a nice day") == 0 == one("")
    assert one("not now. an idiot") == plain  # a clause ends the scope
    assert len(grammar.table) == len({s for s, _ in grammar.table}) * len(toxicity.SYMBOLS)


def held_out(spark, query, label, parts, rest):
    out = {r.doc_id: r for r in query(spark, DATA).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % parts == rest) and 0 <= r.score <= 1 for d, r in out.items())
    pairs = [(labels[d], r.predicted) for d, r in out.items() if r.held_out and d in labels]
    return sum(a == b for a, b in pairs) / len(pairs), out


def test_toxicity_held_out(spark):
    accuracy, out = held_out(spark, toxicity.op6, "toxic", 3, 1)
    assert accuracy >= 0.93 and all(r.predicted == (r.score >= 0.7) for r in out.values())


def test_quality_held_out(spark):
    accuracy, out = held_out(spark, compression_quality.op8, "quality", 5, 0)
    assert accuracy >= 0.9 and all(r.predicted == (r.score >= 0.3) for r in out.values())


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (compression_quality, "quality")])
def test_special_cases(spark, module, label):
    rows = [(1, "you idiot", 3), (2, None, 3), (3, "", 3), (None, "fine words", 3), (1, "you idiot", 3), (4, "idiot " * 100_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    out = module.score(docs, module.learn(docs, none, label)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    few = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 1)], f"doc_id long, {label} int")
    assert len(module.score(docs, module.learn(docs, few, label)).collect()) == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert module.score(empty, module.learn(empty, few, label)).count() == 0


def test_copies_do_not_make_a_lexicon(spark):
    """Words of one toxic text with many copies are not insults; a word in many contexts is."""
    other = [f"plain{i} words{i} of{i} text{i}" for i in range(60)]
    toxic = ["harbour bridge river winter zzgrub"] * 40 + [f"a{i} zzgrub b{i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(toxic + other)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels).lexicon
    assert "zzgrub" in lexicon and "harbour" not in lexicon


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input against the plain rule of its operator."""
    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = common.Scratch(spark, "test").write(stage(spark, docs, folder), "out")
        before, after = ({r.doc_id: r for r in f.collect()} for f in (docs, out))
        assert set(after) <= set(before)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "quality rules":
            verdicts = {r.doc_id: r.kept for r in quality_rules.judged(docs).collect()}
            assert set(after) == {d for d, k in verdicts.items() if k} and all(after[d] == before[d] for d in after)
        elif name == "line dedup":
            seen: list[str] = []
            from test_dedup import brute_lines

            gone = brute_lines([(d, r.text) for d, r in before.items()])
            for d, r in after.items():
                assert r.text.split("\n") == [x for n, x in enumerate(before[d].text.split("\n")) if (d, n) not in gone] and r.n_chars == len(r.text)
            assert not seen and gone
        elif name == "near dedup":
            from test_dedup import brute_groups

            groups, _ = brute_groups([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d, g in groups.items() if d == g}
        elif name == "decontamination":
            held = {r.doc_id for r in decontamination.find(docs, common.table(spark, folder, "benchmark")).collect()}
            assert set(after) == set(before) - held
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
        docs = out
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(after)


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(None, None, None), (1, None, "x"), (2, "", "x"), (3, "some words", "x"), (3, "some words", "x")]
    for frame in (spark.createDataFrame(rows, "doc_id long, text string, removed string"), spark.createDataFrame([], "doc_id long, text string, removed string")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "/root/testdata/sf0.001")
            assert out.count() <= frame.count() and (name == "sentencepiece" or out.columns == frame.columns)


def test_near_and_decontaminated_documents_are_apart(spark):
    assert near_dedup.PERCENT >= 80 and decontamination.SHARE >= 0.8 and near_dedup.SHINGLE == decontamination.WINDOW == 5
