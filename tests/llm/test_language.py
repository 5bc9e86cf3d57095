import random
import re

import zstandard

from feedloom.llm.language import classify, encoders, fit_dictionaries, identify_languages, keep_identified, remainder

WORDS = {"aa": "bala kodu mire santo luve pirra".split(), "bb": "xuth grenk plovst drim wekk zorn".split(), "cc": "ñandé çuñ évê öst ürß".split()}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + ("." if r.random() < 0.1 else "") for _ in range(n)).capitalize()


def table(spark, n=240):
    rows = [(i, prose("abc"[i % 3] * 2, 1 + i % 80, i), "abc"[i % 3] * 2, "x") for i in range(n)]
    rows += [(1000, None, "aa", "x"), (1001, "", "bb", None), (1002, "12 34 !!", "cc", "x"), (1003, prose("bb", 9000, 7), None, "x")]
    rows += [(None, prose("cc", 30, 3), "cc", "x"), (5, prose("cc", 30, 3), "cc", "x"), (5, prose("cc", 30, 3), "cc", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, __score string")


def test_held_out_accuracy_and_defined_cases(spark):
    docs = table(spark)
    found = fit_dictionaries(docs.filter(remainder("doc_id", 4) != 2))
    assert set(found) == {"aa", "bb", "cc"}
    got = {r.doc_id: r for r in identify_languages(docs, found).collect()}
    assert sum(got[i].lang_pred == "abc"[i % 3] * 2 for i in range(240)) >= 236
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[1003].lang_pred == "bb" and got[None].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got.values())
    kept = keep_identified(docs, found)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(r.rejected for r in got.values())


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = [(i, f"same text {i % 2}", "aa") for i in range(500)] + [(i, f"word{i} other", "bb") for i in range(500, 900)]
    found = fit_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=50)
    assert found["aa"].count(b"same") <= 2 and found["bb"].count(b"other") <= 50


def test_equals_a_plain_walk_over_all_dictionaries(spark):
    """Lengths of encodings, summed, ties to the language that sorts first; 'dd' has the dictionary of 'aa'."""
    docs = table(spark)
    found = fit_dictionaries(docs.filter(remainder("doc_id", 4) != 2))
    found["dd"] = found["aa"]
    rows = {r.doc_id: r for r in identify_languages(docs.filter("doc_id > 5"), found).collect()}
    for r in docs.filter("doc_id > 5").collect():
        low = " " + re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).strip()
        parts = [low[i : i + 500] for i in range(0, len(low), 500)]

        def bits(lang, parts):
            d = zstandard.ZstdCompressionDict(found[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False)
            return sum(len(c.compress(p.encode())) for p in parts)

        if low == " ":
            assert rows[r.doc_id].lang_pred == "und"
            continue
        sums = sorted((bits(lang, parts), lang) for lang in found)
        if sums[0][0] > sums[1][0] * (1 - 0.0005):
            for p in list(parts):
                words = p.split(" ")
                parts += [" ".join(["", *words[i:]]) for i in range(2, len(words))] + [" " + w for w in words]
            sums = sorted((bits(lang, parts), lang) for lang in found)
        got = rows[r.doc_id]
        assert (got.lang_pred, got.score) == (sums[0][1], 1 - sums[0][0] / sums[1][0])
        assert got.lang_pred != "dd" and got.rejected == (got.score < 0.0005)


def test_no_labels_one_language_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert fit_dictionaries(empty) == {} and identify_languages(empty, {}).count() == 0
    assert classify("some words", []) == ("und", 0.0)
    assert classify("some words", encoders({"aa": b" bala kodu mire santo"})) == ("aa", 1.0)
