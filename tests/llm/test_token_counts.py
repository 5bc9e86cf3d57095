import random
import re
from functools import lru_cache

import public_tokenizers
import pytest

from feedloom.llm import token_counts
from feedloom.llm.token_counts import Trie, Unigram, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
R = random.Random(8)


def brute(word: bytes, model: Unigram) -> tuple[float, int]:
    """The best split, tried from the front."""

    @lru_cache(None)
    def rest(at: int) -> tuple[float, int]:
        if at == len(word):
            return 0.0, 0
        ways = [(model.byte + rest(at + 1)[0], -1 + rest(at + 1)[1])]
        for end in range(at + 1, len(word) + 1):
            if (s := model.scores.get(word[at:end])) is not None:
                ways.append((s + rest(end)[0], -1 + rest(end)[1]))
        return max(ways)

    score, minus = rest(0)
    return score, -minus


def test_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 300)
    model = Unigram.of_model(MODEL)
    words = ["".join(R.choice("thenarioslé▁中😀.") for _ in range(R.randint(1, 14))) for _ in range(400)]
    trie = Trie(model)
    for word in words + words:
        pre = b" " + word.encode()
        score, count = brute(pre, model)
        _, n, s = trie.tokens(word)
        assert s == pytest.approx(score) and n == count
    rows = [(i, " ".join(R.choice(words) for _ in range(i % 50)), "x") for i in range(100)]
    rows += [(200, None, "x"), (None, "", None), (201, " \n\t", "x"), (202, "ab" * 5_000, "x"), (3, rows[3][1], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = count_tokens(docs, MODEL).collect()
    texts = {(r[0], r[1] or "") for r in rows}
    assert len(out) == len(rows)
    for r in out:
        text = next(t for d, t in texts if d == r.doc_id)
        parts = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = [Trie(model).outside(b" " + p.encode()) if len(p) > 100 else brute(b" " + p.encode(), model)[::-1] for p in parts]
        assert (r.n_words, r.n_tokens) == (len(parts), sum(n for n, _ in own)) and r.score == pytest.approx(sum(s for _, s in own))


def test_shared_prefixes_are_worked_out_once():
    class Counting(Unigram):
        steps = 0

        def step(self, *a):
            Counting.steps += 1
            return super().step(*a)

    trie = Trie(Counting([b" in", b"ter", b"n", b"a"]))
    for word in (b" internal", b" internals", b" inter", b" internal"):
        trie.insert(word)
    assert Counting.steps == len(b" internals")


def test_long_and_short_words_agree():
    trie = Trie(Unigram.of_model(MODEL))
    word = b" " + b"international" * 4
    assert trie.insert(word) == trie.outside(word)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
