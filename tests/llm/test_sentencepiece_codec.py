import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from brevispark.llm import sentencepiece_codec as op

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   a  b ", "a▁b ▁▁ c", "\n\n x\ty", "Ａﬁ① ǅ é 한글", "😀😀 ‍ x", "<s> </s> <0x41>", "a" * 300, "  nb　sp  ", "trail ", "½ ™", "\x00a \x01", "Straße größer ciónñ éèê"]


def with_normaliser(rule, squeeze):
    model = pb.ModelProto()
    model.ParseFromString(op.model_bytes(PATH))
    own = pb.ModelProto()
    own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap, model.normalizer_spec.name = own.normalizer_spec.precompiled_charsmap, rule
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    return model.SerializeToString()


@pytest.mark.parametrize("model", [None, ("nmt_nfkc", True), ("nmt_nfkc", False), ("nfkc_cf", True)])
def test_ids_and_spans_equal_the_library(model):
    raw = op.model_bytes(PATH) if model is None else with_normaliser(*model)
    full = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids, begins, ends, at = op.Codec(raw).encode([t.encode() for t in TEXTS], False, False)
    for i, text in enumerate(TEXTS):
        got = list(zip(ids[at[i] : at[i + 1]].tolist(), begins[at[i] : at[i + 1]].tolist(), ends[at[i] : at[i + 1]].tolist()))
        assert got == [(p.id, p.begin, p.end) for p in full.encode(text, return_type="proto").pieces], text


ALPHABET = st.text(alphabet=" a▁éＡﬁ①ǅ한\u3000\u00a8\u00ad\n\t½™e\u0301ｶ\uff9e", max_size=14)


@pytest.mark.parametrize("model", [None, ("nmt_nfkc", True), ("nmt_nfkc", False), ("nfkc_cf", True), ("nfkc", False)])
def test_all_at_once_equals_step_by_step_and_the_library(model):
    raw = op.model_bytes(PATH) if model is None else with_normaliser(*model)
    codec, full = op.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(ALPHABET, max_size=5))
    def check(texts):
        data = [t.encode() for t in texts]
        norm, at, origin = codec.normalise_all(data)
        for i, t in enumerate(data):
            want, where = codec.normalise(t)
            assert norm[at[i] : at[i + 1]] == want and origin[at[i] + i : at[i + 1] + i + 1].tolist() == where.tolist()
        ids, begins, ends, at = codec.encode(data, False, False)
        for i, text in enumerate(texts):
            own = slice(at[i], at[i + 1])
            assert list(zip(ids[own].tolist(), begins[own].tolist(), ends[own].tolist())) == [(p.id, p.begin, p.end) for p in full.encode(text, return_type="proto").pieces], text

    check()


def test_all_documents_with_their_spans(spark):
    """Ids, spans and decoded text of whole tables equal the library's, for the given model and one with a character map."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for raw in (op.model_bytes(PATH), with_normaliser("nmt_nfkc", True)):
        full = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids, begins, ends, at = op.Codec(raw).encode([t.encode() for t in texts], True, True)
        for i, text in enumerate(texts):
            own = slice(at[i], at[i + 1])
            pieces = full.encode(text, return_type="proto").pieces
            assert ids[own].tolist() == [1, *(p.id for p in pieces), 2]
            assert begins[own].tolist()[1:-1] == [p.begin for p in pieces] and ends[own].tolist()[1:-1] == [p.end for p in pieces]


def test_bytes_that_are_no_text():
    assert op.valid([b"a\xff", None, "é".encode()]) == ["a\ufffd".encode(), b"", "é".encode()]


def test_memory_may_be_emptied(monkeypatch):
    monkeypatch.setattr(op, "MOST_WORDS", 3)
    raw = op.model_bytes(PATH)
    codec = op.Codec(raw)
    full = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for _ in range(3):
        ids, _, _, at = codec.encode([t.encode() for t in TEXTS], True, True)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [full.encode(t, add_bos=True, add_eos=True) for t in TEXTS]


def test_digests_of_odd_rows(odd_documents):
    full = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted(op.digests(op.encode_documents(odd_documents, PATH, packed=True)).collect(), key=str)
    want = []
    for r in odd_documents.collect():
        ids = full.encode(r.text or "", add_bos=True, add_eos=True)
        pieces, n = full.encode(r.text or "", return_type="proto").pieces, len((r.text or "").encode())
        spans = np.array([0, *(p.begin for p in pieces), n, 0, *(p.end for p in pieces), n], "<u4").tobytes()
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(full.decode(ids).encode()).hexdigest(), hashlib.sha256(spans).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_arrays_and_extra_columns(odd_documents):
    out = op.encode_documents(odd_documents, PATH, keep=tuple(odd_documents.columns)).where("doc_id = 11").first()
    assert out.ids[0] == 1 and out.ids[-1] == 2 and out.ends[-1] == 7 and out.spans == 2


def test_empty_table(no_documents):
    assert op.encode_documents(no_documents, PATH).count() == 0
