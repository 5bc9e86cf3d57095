import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from feedloom.llm import pieces
from feedloom.llm.pieces import Normalizer, codec, decode_documents, digest_documents, encode_documents, merge

MODEL = public_tokenizers.path("piece_bpe_32k.model")
R = random.Random(4)
TEXTS = ["", " ", "  a", "\n x", "▁▁ a ▁", "日本語 テスト", "😀 ok\x00z", "a" * 500 + " bb", "<s> </s> x", "é́  double  ", "x\r\n\ty", "� q",
         "ab" * 3000, " ".join("".join(R.choice("abcdeéñ.,|") for _ in range(R.randint(1, 12))) for _ in range(20_000))]
TEXTS += ["".join(R.choice("ab \n▁é.中😀0") for _ in range(R.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_spans_and_text_equal_the_librarys(library):
    c = codec(MODEL)
    for text in TEXTS:
        ids, ends = c.encode(text)
        want = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces]
        assert ends.tolist() == [p.end for p in want.pieces]
        assert c.decode(ids) == library.decode(ids.tolist())


def test_decoding_of_broken_bytes(library):
    c = codec(MODEL)
    for ids in ([1, 198, 172, 2], [259, 300, 198], [229, 186, 198], [229, 186], [2], [0, 400]):
        assert c.decode(np.array(ids)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_map_normalises_as_the_librarys(rule):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.NormalizerSpec.FromString(lib.serialized_normalizer_spec())
    own = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    texts = ["ﬁn Ⅷ ①", "ｶﾞ ｈａｌｆ", "é Å ẞ", "a​b\tc\r\nd", "", "½ ㎏ 株式会社 ㍿", *TEXTS[:40]]
    for text in texts:
        data, source = own(text.encode())
        assert data.decode() == lib.normalize(text)
        assert len(source) == len(data) + 1 and source[-1] <= len(text.encode()) and (np.diff(source) >= 0).all()
    data, source = own("  \ufb01   x  ".encode())
    assert data.decode() == "▁fi▁x" and source.tolist() == [2] * 5 + [5] * 3 + [8, 9]
    data, source = Normalizer(spec.precompiled_charsmap, False, False, escape=False)("\ufb01 x".encode())
    assert data == b"fi x" and source.tolist() == [0, 0, 3, 4, 5]


def test_merging_long_and_short_parts_agree():
    scores = codec(MODEL).scores
    for n in (190, 200, 201, 260):
        text = "".join(R.choice("thenarion") for _ in range(n))
        from feedloom.llm.pieces import _merge_long

        assert _merge_long(text[:200], scores) == merge(text[:200], scores)


def test_documents_round_trip_and_digests(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS[:80])] + [(None, None, None), (3, "\n x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = encode_documents(docs, MODEL)
    got = {r.doc_id: r for r in encoded.collect()}
    assert got[None].ids == [1, 2] and got[None].ends == [0, 0]
    back = {r.doc_id: r.text for r in decode_documents(encoded, MODEL).collect()}
    for r in digest_documents(docs, MODEL).collect():
        text = TEXTS[r.doc_id] if r.doc_id is not None else ""
        ids = [1, *library.encode(text), 2]
        assert got[r.doc_id].ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert back[r.doc_id] == library.decode(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.covered_bytes == len(text.encode())


def test_empty_table(spark):
    assert digest_documents(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_a_large_batch_is_encoded_a_little_at_a_time():
    words = [f"w{i * 7919 % 10007}" for i in range(40_000)]
    texts = [" ".join(words[i : i + 200]) for i in range(0, len(words), 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    c = pieces.codec(MODEL)
    tracemalloc.start()
    got = sum(out.num_rows for out in pieces._encoder(MODEL, True)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(texts) and batch.nbytes > 2 << 20
    assert peak < 48 << 20 and not c.new  # a batch as a whole took more
