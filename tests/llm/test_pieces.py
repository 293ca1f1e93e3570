import pytest
from hypothesis import given, settings, strategies as st

from samewise.llm import pieces

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", "a", " ", "  hello   world ", "été 😀 한국어 中文字符\n\n\ttab  \n x", "a" * 3000, " " * 37 + "x", "the theatre▁x", "unbelievable internationalization http://x.com/?a=1&b=2", "____ ---- ==== ....", "\x00\x01 \u200b", "가나다 👩‍👩‍👧"]


@pytest.fixture(scope="module")
def both():
    import sentencepiece as spm

    raw = open(PATH, "rb").read()
    return pieces.Model(raw), spm.SentencePieceProcessor(model_proto=raw)


def ids_of(model, texts):
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    ids, first, same = pieces._encoded(model, rows, 0)
    assert same.all()
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def test_like_the_library(both):
    model, sp = both
    assert ids_of(model, TEXTS) == sp.encode(TEXTS, num_threads=1)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(both, text):
    model, sp = both
    assert ids_of(model, [text]) == [sp.encode(text)]


def test_forgetting_changes_nothing(both, monkeypatch):
    model, sp = both
    monkeypatch.setattr(pieces, "UNITS", 1)
    monkeypatch.setattr(pieces, "PAIRS", 1)
    for t in TEXTS:
        assert ids_of(model, [t]) == [sp.encode(t)]


def test_frames(spark, tricky, nothing, both):
    rows = pieces.encoded(tricky, PATH).collect()
    assert len(rows) == tricky.count() and all(r.round_trip for r in rows)
    back = pieces.decoded(pieces.encoded(tricky, PATH), PATH)
    want = sorted(((r.doc_id, r.text or "") for r in tricky.select("doc_id", "text").collect()), key=str)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == want
    digests = pieces.token_digests(tricky, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in digests} == {r.doc_id: len(r.ids) for r in rows}
    assert pieces.encoded(nothing, PATH).count() == 0


def thue_morse(n, flip=False):
    return "".join("ab"[i.bit_count() % 2 ^ flip] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_units_that_polynomials_confuse(both, n):
    model, sp = both
    texts = [thue_morse(n), thue_morse(n, True)]
    assert ids_of(model, texts) == sp.encode(texts, num_threads=1)


def test_lossless_is_of_the_source(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a▁b"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.round_trip, r.lossless) for r in pieces.encoded(docs, PATH).collect()) == [(1, True, True), (2, True, False), (3, True, True)]


def test_other_models_are_refused(monkeypatch, both):
    monkeypatch.setattr(pieces.Model, "encode_units", lambda self, units: ([], []))
    with pytest.raises(Exception):
        pieces.Model(open(PATH, "rb").read())
