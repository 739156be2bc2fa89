"""Token counts, SentencePiece, quality rules: against the libraries and brute force."""

import re
import weakref
from collections import defaultdict

import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontamination, near_dedup, quality_rules, sentencepiece_fst, sentencepiece_model, token_counts

MODEL = public.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
with open(MODEL, "rb") as file:
    CONTENT = file.read()
TRANSDUCER = sentencepiece_fst.compile_model(CONTENT)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", " a  b ", "\n", "a\n b", "▁", "a▁b", "a ▁ b", "</s> <s>[INST]", "日本 語é̈ ​ x", "x" * 3000 + " " + " " * 20, "aaaaaaa aaaa",
       "<0x0A> <unk>", "1234567890 000000", "def f(x):\n    return  x\n", "안녕 하세요 мир", "😀😀 é", "word " * 30000, "\u0000\u0001"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids(text):
    return [int.from_bytes(x, "little", signed=True) for x in map(bytes, zip(*[iter(TRANSDUCER.encode(text))] * 4, strict=True))]


def test_path_is_the_library_encoding():
    for text in ODD:
        assert ids(text) == LIBRARY.encode(text), repr(text[:40])
        assert TRANSDUCER.decode(ids(text)) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinrst ▁\n.1éΩ日", max_size=24))
def test_path_is_the_library_encoding_of_any_text(text):
    assert ids(text) == LIBRARY.encode(text)
    if "▁" not in text:
        assert TRANSDUCER.decode(ids(text)) == text


def test_stability_by_spines_is_that_by_merging():
    pieces = [p for p in TRANSDUCER.model.pieces[300:32000:331]]
    for a in pieces:
        for b in pieces[::7]:
            TRANSDUCER.pairs.pop((a, b), None)
            assert TRANSDUCER._stable(a, b) == (TRANSDUCER._merged(a + b) == [a, b])


def test_unigram_takes_the_lightest_path():
    kinds = (2, 3, 3) + (1,) * 5
    model = sentencepiece_model.Model(("<unk>", "<s>", "</s>", "▁", "a", "b", "ab", "▁a"), (0, 0, 0, -2.0, -3.0, -3.0, -4.0, -2.5), kinds, 1, False, "identity", b"", True, False, True)
    tool = sentencepiece_fst.Transducer(model)
    assert tool.best_path("▁ab") == ["▁a", "b"]  # 5.5 against 6 for ▁ ab
    assert list(tool.encode("ab")) and tool.best_path("") == []


def test_round_trip_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "x"), (3, "a", "x")]
    out = sentencepiece_fst.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    for i, t in enumerate(ODD):
        assert by[i].token_ids == LIBRARY.encode(t) and by[i].n_tokens == len(by[i].token_ids)
        assert by[i].round_trip == ("▁" not in t)
    assert next(r for r in out if r.doc_id is None).n_tokens == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepiece_fst.round_trip(empty, MODEL).count() == 0
    again = sentencepiece_fst.decode(sentencepiece_fst.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), MODEL), MODEL).first()
    assert again.decoded == "a b"


def test_token_counts(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, None, 1), (3, "a", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    out = token_counts.count_tokens(frame, MODEL, limit=100).collect()
    assert len(out) == len(rows)
    for r in out:
        t = ODD[r.doc_id] if r.doc_id is not None else ""
        if r.doc_id != 3 or r.text == "a":
            t = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(LIBRARY.encode(t))) and r.over_limit == (r.n_tokens > 100)
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_long_texts_are_cut_safely(name):
    path = public.path(name)
    with open(path, "rb") as file:
        tool = token_counts.encoder(path, file.read(), public.PATTERN)
    texts = [("some words of text\n" + "and Other lines.\n\n  \n") * 9000, "", "a\nb"]
    whole = tool.count(texts)
    assert token_counts.text_counts(tool, texts, {}) == whole and len(tool.segments(texts[0])) > 1


def brute(text):
    words = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "\n", "#|"]), max_size=60))
def test_repeats_against_brute_force(parts):
    text = " ".join(parts)
    _, _, _, lines, words = brute(text)
    assert quality_rules.repeated_words(WORD.findall(text)) == words and quality_rules.repeated_lines(text) == lines


PROSE = ("The committee met on Tuesday to review the plan for the new harbour bridge and heard from engineers who had studied the river bed during the winter. "
         "Several residents asked whether traffic would grow, and the chair promised a second public session before any contract is signed next spring.")  # fmt: skip


def test_quality_rules(spark):
    rows = [(1, PROSE, "en", 5), (2, None, None, 5), (3, "", "en", 5), (4, "word " * 40, "en", 5), (5, "\n".join([PROSE] * 2), "en", 5),
            (6, PROSE, None, 5), (7, "Погода сегодня хорошая и мы пойдём гулять в парк у реки вместе с друзьями", "ru", 5),
            (8, " ".join(f"{w}%%%$$$###" for w in PROSE.split()), "en", 5), (1, PROSE, "en", 5), (9, "x" * 200000, "en", 5)]
    out = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True, 8: False, 9: False}
    assert quality_rules.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    frame = spark.createDataFrame([(1, PROSE, "en", 5)], "doc_id long, text string, lang string, kept int")
    assert quality_rules.kept_documents(frame).first().asDict() == frame.first().asDict()


def test_stages_free_the_tool_that_another_one_left(spark, monkeypatch):
    """Spark's Python processes serve several stages; what one remembers must not stand beside the next."""
    docs = spark.createDataFrame([(1, "a text of a few words", "en")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, "seven words that only stand in one place")], "item_id long, text string")
    mappers, kind, mapped = [], type(docs), type(docs).mapInArrow

    def kept(self, run, schema):
        mappers.append(run)
        return mapped(self, run, schema)

    monkeypatch.setattr(kind, "mapInArrow", kept)
    quality_rules.kept_documents(docs)
    decontamination.clean(docs, bench)
    near_dedup.deduplicate(docs)
    assert len(mappers) >= 4
    list(mappers[0](iter([])))  # the tool at the top of this file stays in use
    for run in mappers:
        tool = sentencepiece_fst.compile_model(CONTENT)
        assert sentencepiece_fst.compile_model(CONTENT) is tool
        held = weakref.ref(tool)
        del tool
        list(run(iter([])))
        assert held() is None
