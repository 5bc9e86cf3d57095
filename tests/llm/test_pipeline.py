import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece

import corpus_pipeline
from feedloom.llm import language

from .test_jaccard import brute
from .test_mixing import targets_by_rounds

DATA = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        seen.append((docs.collect(), (docs := spark.read.parquet(path)).collect()))
        if name != "encode_pieces":
            assert docs.columns == columns
    (raw, known), (_, distinct), (_, single), (_, mixed), (_, encoded) = seen

    labelled = spark.createDataFrame(raw).filter(language.remainder("doc_id", 4) != 2)
    by_lang = language.encoders(language.fit_dictionaries(labelled))
    got = {r.doc_id: language.classify(r.text, by_lang) for r in raw}
    assert {r.doc_id for r in known} == {d for d, (lang, score) in got.items() if lang != "und" and score >= language.MARGIN}
    assert len(known) >= 0.97 * len(raw)

    keep = {}
    for r in known:
        keep[r.text] = max(keep.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in distinct) == sorted(keep.values())

    assert sorted(r.doc_id for r in single) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in distinct])})

    sizes, taken, own = Counter(), Counter(), {r.doc_id: r for r in single}
    for r in single:
        sizes[r.source] += len(r.text.split())
    words = defaultdict(int)
    for r in mixed:
        taken[r.source] += len(r.text.split())
        words[r.doc_id] += len(r.text.split())
        assert (r.lang, r.source) == (own[r.doc_id].lang, own[r.doc_id].source) and r.n_chars == len(r.text)
        assert set(r.text.split()) <= set(own[r.doc_id].text.split())
    assert all(words[d] <= 2 * len(own[d].text.split()) for d in words)
    for source, target in targets_by_rounds(sizes).items():
        assert abs(taken[source] - target) <= 128

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in mixed:
        ids = [1, *library.encode(r.text), 2]
        want[r.doc_id, tuple(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in encoded) == want


def test_the_last_stage_gives_the_library_s_byte_spans(spark):
    texts = ["The cat sat.", "", None, "Été – 12 000 €\n\n  two  spaces", "日本語 and ▁ signs"]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select(docs.columns).limit(100)
    rows = docs.union(documents.withColumn("doc_id", documents.doc_id + 1000))
    own = {r.doc_id: r.text for r in rows.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ends for r in corpus_pipeline.encode(spark, rows, DATA).collect()}
    assert set(got) == set(own)
    for d, text in own.items():
        ends = [p.end for p in library.encode(text or "", return_type="proto").pieces]
        assert got[d] == [0, *ends, ends[-1] if ends else 0]


def test_stages_with_nulls_repeats_and_empty_tables(spark, tmp_path):
    base = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    text = base.filter("length(text) > 400").first().text
    odd = [(None, text, None, None, 1), (None, text, None, None, 1), (-7, None, "en", "x", 0), (-8, "", "en", None, 0), (-9, "12 34", None, "x", 5), (-9, "12 34", None, "x", 5)]
    docs = base.union(spark.createDataFrame(odd, base.schema))
    for name, rows in (("odd", docs), ("none", base.limit(0))):
        for stage, run in corpus_pipeline.STAGES:
            run(spark, rows, DATA).write.parquet(path := f"{tmp_path}/{name}-{stage}")
            rows = spark.read.parquet(path)
        if name == "none":
            assert rows.count() == 0
        else:
            assert {-7, -8, -9} & {r.doc_id for r in rows.collect()} == set() and rows.count() > 0
