import hashlib
import random

import pytest

from feedloom.llm import fuzzy
from feedloom.llm.fuzzy import common_length, edited_fingerprints, fingerprint, fingerprint_documents, likeness

R = random.Random(5)


def prose(n):
    return " ".join("".join(R.choice("etaoinshrdlé") for _ in range(R.randint(1, 9))) for _ in range(n))


def plain(data: bytes) -> str:
    """Byte by byte: roll, cut, hash each piece with Horner's rule from its end."""
    n, block = len(data), 3
    while block * 64 < n:
        block *= 2
    if not n:
        return "3::"
    mask = (1 << 64) - 1

    def trigger(i, size):
        r = sum((data[i - k] + 1) * pow(0x9E3779B1, k + 1, 1 << 64) for k in range(min(7, i + 1))) & mask
        r ^= r >> 29
        return (((r * 0xBF58476D1CE4E5B9) & mask) >> 32) % size == size - 1

    def signature(size):
        out, piece = "", []
        for i, byte in enumerate(data):
            piece.append(byte + 1)
            if (trigger(i, size) and len(out) < 127) or i == n - 1:
                h = sum(x * pow(0x100000001B3, j, 1 << 64) for j, x in enumerate(piece)) & mask
                h ^= h >> 32
                out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[((h * 0x94D049BB133111EB) & mask) >> 58]
                piece = []
        return out

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_fingerprints_equal_a_plain_walk_over_the_bytes():
    for text in ["", "a", "ab", "aaaaaaaaaaaaaaaaaaaaaaaa" * 20, prose(3), prose(60), prose(900), "é" * 50]:
        assert fingerprint(text.encode()) == plain(text.encode())


def test_edit_distance_by_bits():
    for _ in range(200):
        a, b = ("".join(R.choice("abcd") for _ in range(R.randint(0, 70))) for _ in range(2))
        assert common_length(a, b) == lcs(a, b)


def test_likeness_tells_edits_from_strangers():
    near, far = [], []
    for _ in range(60):
        a, b = prose(R.randint(60, 900)), prose(R.randint(60, 900))
        k = len(a) // 2
        near.append(likeness(fingerprint(a.encode()), fingerprint((a[: len(a) - k] + b[:k]).encode())))
        far.append(likeness(fingerprint(a.encode()), fingerprint(b.encode())))
    assert min(near) > 0.3 and sum(near) / 60 > 0.45 and sum(x > 0.2 for x in far) <= 1
    assert likeness("3::", "3::") == 1.0 and likeness("3::", fingerprint(b"abc")) == 0.0


@pytest.mark.parametrize("range_rows", [4, 3_000])
def test_next_documents_cross_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(fuzzy, "RANGE_ROWS", range_rows)
    rows = [(i * 7 % 101, prose(R.randint(1, 60))) for i in range(60)] + [(500, None), (501, ""), (502, "x" * 50_000), (None, "no id"), (None, "another")]
    rows += [(14, "twice"), (14, "twice"), (14, None)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, range string")
    ordered = sorted(((a, b or "") for a, b in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(text) // 2
        edited = (text[: len(text) - k] + after[:k]).encode()
        own, new = fingerprint(text.encode()), fingerprint(edited)
        want.append((i, len(text), hashlib.sha256(edited).hexdigest(), own, new, likeness(own, new), likeness(own, fingerprint(after.encode()))))
    got = [tuple(r) for r in edited_fingerprints(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    plain_prints = sorted((tuple(r) for r in fingerprint_documents(docs).collect()), key=str)
    assert plain_prints == sorted([(w[0], w[1], w[3]) for w in want], key=str)


def test_one_row_and_none(spark):
    one = edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
