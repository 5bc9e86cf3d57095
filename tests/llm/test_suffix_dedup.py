import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import induced, suffix_dedup
from feedloom.llm.induced import STEP, Scratch, sorted_suffixes
from feedloom.llm.suffix_dedup import repeated_spans

R = random.Random(6)


def words(n):
    return " ".join("".join(R.choice("etaoinshrdlé") for _ in range(R.randint(1, 9))) for _ in range(n))


def brute(rows):
    """Every 100-byte string in order of id, null last, text and place; those met before go."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    met, out = set(), []
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            s = data[at : at + 100]
            if s in met:
                gone[at : at + 100] = b"\x01" * 100
            met.add(s)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((rows[i][0], len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rows, passage, line = [], words(60), words(30)
    for i in range(60):
        text = words(R.randint(0, 80))
        if i % 3 == 0:
            text = text[: len(text) // 2] + passage[R.randint(0, 40) : -R.randint(1, 40)] + text[len(text) // 2 :]
        if i % 4 == 0:
            text += "\n" + line + "\n" + line[: R.randint(80, len(line))]
        rows.append((i * 7 % 101, text))
    near = words(120)
    for i in range(20):
        at = R.randrange(len(near))
        rows.append((200 + i, near[:at] + R.choice("xyz") + near[at + 1 :]))
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, "ab" * 400), (303, "a" * 99), (304, "a" * 100), (305, "a" * 101), (306, None), (307, "")]
    return rows + [(308, "é" * 300), (309, "Eran. " * 90), (310, "x" + "Eran. " * 60)]


def found(spark, rows):
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, key int").repartition(5)
    return sorted((tuple(r)[:5] for r in repeated_spans(docs).collect()), key=str)


@pytest.mark.parametrize("segment", [1 << 17, 700])
def test_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_repeated_and_missing_ids(spark):
    text, other = words(50), words(50)
    rows = [(1, text), (1, text), (1, other + text), (None, other), (None, None), (0, other[:150])]
    assert found(spark, rows) == brute(rows)


def test_spans_and_empty_table(spark):
    a = words(40)
    out = {r.doc_id: r.spans for r in repeated_spans(spark.createDataFrame([(1, a), (2, "zz" + a + "!")], "doc_id long, text string")).collect()}
    n = len(a.encode())
    assert out[1] == [] and [(s.begin, s.end) for s in out[2]] == [(2, 2 + n)]
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_cores_are_dealt_to_several_shards(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r)[:5] for r in repeated_spans(docs, hot=2).collect()), key=str) == brute(rows)


def test_segments_of_a_long_text_have_the_same_runs():
    data = (words(500) + "ab" * 300 + words(300)).encode()
    whole = suffix_dedup.runs([data])
    assert (np.concatenate([[-1], whole[4][:-1]]) + 1 == whole[3]).all() and whole[4][-1] == len(data) - 100
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_dedup, "SEGMENT", 333)
        cut = suffix_dedup.runs([data])
        among = suffix_dedup.runs([b"short", data[:150], data, data[99:]])
    assert all((x == y).all() for x, y in zip(whole, cut))
    assert all((x == y[among[2] == 2]).all() for x, y in zip(whole[3:], among[3:]))


@pytest.mark.parametrize("names", [0, 3, 1 << 22])
@pytest.mark.parametrize("block", [3, 1 << 18])
def test_suffixes_sorted_by_induction(monkeypatch, block, names):
    monkeypatch.setattr(induced, "BLOCK", block)
    monkeypatch.setattr(induced, "NAMES", names)
    for _ in range(60):
        text = bytes(R.randint(1, R.choice([1, 2, 5, 200])) for _ in range(R.randint(0, 60))) * R.randint(1, 4) + b"\0"
        cap = R.choice([3, 100, 300])
        t = np.zeros(len(text) + STEP, np.uint8)
        t[: len(text)] = np.frombuffer(text, np.uint8)
        parts = list(sorted_suffixes(t, len(text), 200, cap))
        order, shared = (np.concatenate([p[k] for p in parts]).tolist() for k in (0, 1))
        assert sorted(order) == list(range(len(text)))
        for a, b, k in zip(order, order[1:], shared[1:]):
            real = next(j for j in range(cap + 1) if j == cap or text[a + j] != text[b + j])
            assert k == real and (k == cap or text[a + k] > text[b + k])


def test_a_shard_beyond_its_memory_goes_to_disk(monkeypatch):
    made = []
    real = Scratch.array
    monkeypatch.setattr(Scratch, "array", lambda self, n, kind: made.append(n * np.dtype(kind).itemsize > self.left) or real(self, n, kind))
    pieces = [words(40).encode()[:168] for _ in range(300)]
    pieces += [p[20:150] for p in pieces[:200]]
    table = pa.table({"key": list(range(500)), "start": pa.array([7] * 500, pa.int32()), "bytes": pieces, "hot": [False] * 500})
    got = []
    for memory in (1 << 30, 0):
        made.clear()
        shard = suffix_dedup.Shard(iter(table.to_batches(64)), memory)
        assert not list(shard.sort())
        got.append(sorted(tuple(x.tolist()) for part in shard.spans() for x in np.transpose(part)))
        assert all(made) if not memory else not any(made)
    assert got[0] == got[1] == [(300 + i, 7, 7 + 130) for i in range(200)]
