import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import suffix_tree_lm
from feedloom.llm.language import remainder
from feedloom.llm.suffix_tree_lm import BEFORE, END, REST, SuffixTreeModel

R = random.Random(3)
AFTER = {"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["ran", "slept"], "sat": ["on"], "on": ["the"], "ran": ["to"], "to": ["the"], "slept": ["on"]}


def sentence(n):
    words = ["the"]
    for _ in range(n):
        choice = AFTER[words[-1]]
        if words[-1] == "the" and len(words) > 1:  # what follows depends on two words
            choice = choice[:1] if words[-2] == "to" else choice[1:]
        words.append(R.choice(choice) if R.random() < 0.9 else f"odd{R.randrange(500)}ly")
        if words[-1] not in AFTER:
            words.append("the")
    return " ".join(words)


def table(spark, n=300):
    rows = [(i, sentence(R.randint(1, 60)), "x") for i in range(n)] + [(1000, None, "x"), (1001, "", "x"), (1002, "The CAT Été unseen", "x")]
    rows += [(1003, sentence(9_000), "x"), (5, rows[5][1], "x"), (None, "the dog", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, words string")


def tokens(text):
    ascii_lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*ascii_lower.split(), ""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


@pytest.fixture(scope="module")
def model(spark):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_tree_lm, "SYMBOL_SHARE", 3e-3)
        m.setattr(suffix_tree_lm, "CONTEXT_SHARE", 2e-3)
        m.setattr(suffix_tree_lm, "ENTRY_SHARE", 3e-4)
        m.setattr(suffix_tree_lm, "BLOCK_TOKENS", 2_000)
        rows, docs = table(spark)
        fitted = SuffixTreeModel(docs, remainder("doc_id", 10) == 0)
        yield rows, fitted, fitted.score().collect()


def test_counts_and_base_scores_equal_brute_force(model):
    rows, _, got = model
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        own = tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want[i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_scores_equal_a_walk_down_the_tree(model):
    rows, fitted, got = model
    tree = fitted.tree
    assert len(tree.levels) >= 2
    known = {w for i, t, _ in rows if not held(i) for w in tokens(t)}
    for r in got[:60] + got[-6:]:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        own = [END if not w else tree.symbol(w) if w in known else REST for w in tokens(text)]
        gain = 0.0
        for at, s in enumerate(own):
            p, place = tree.root[s], 0
            for k, level in enumerate(tree.levels, 1):
                if at < k - 1:
                    break
                key = place * tree.size + (own[at - k] if at >= k else BEFORE)
                found = np.flatnonzero(level.keys == key)
                if not len(found):
                    break
                place = int(found[0])
                entry = np.flatnonzero(level.entries == place * tree.size + s)
                p = level.chances[entry[0]] if len(entry) else level.left[place] * p
            gain += math.log10(p / tree.root[s])
        assert r.score == pytest.approx(r.base_score + gain, abs=1e-6)


def test_every_state_is_a_distribution(model):
    tree = model[1].tree
    assert tree.root.sum() == pytest.approx(1)
    for k, level in enumerate(tree.levels, 1):
        for place in range(len(level.keys)):
            keys, q = [], place
            for j in range(k, 0, -1):
                keys.append(q)
                q = tree.levels[j - 1].keys[q] // tree.size
            p = tree.root.copy()
            for j, at in zip(range(1, k + 1), reversed(keys)):
                p = p * tree.levels[j - 1].left[at]
                own = tree.levels[j - 1].entries // tree.size == at
                p[tree.levels[j - 1].entries[own] % tree.size] = tree.levels[j - 1].chances[own]
            assert p.sum() == pytest.approx(1, abs=1e-6)


def test_held_out_texts_gain(model):
    out = [r for r in model[2] if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_nothing_to_learn_from_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {(r.score, r.n_known, r.train_tokens) for r in SuffixTreeModel(docs, F.lit(True)).score().collect()} == {(0.0, 0, 0)}
    assert SuffixTreeModel(docs.filter("false"), F.lit(False)).score().count() == 0


def test_counts_and_not_shares_of_the_tokens_bound_the_tree(spark):
    rows, docs = table(spark)
    with pytest.MonkeyPatch.context() as m:  # as in a table so large that a share is far more than a count
        for share in ("SYMBOL_SHARE", "CONTEXT_SHARE", "ENTRY_SHARE"):
            m.setattr(suffix_tree_lm, share, 0.5)
        m.setattr(suffix_tree_lm, "BLOCK_TOKENS", 2_000)
        tree = SuffixTreeModel(docs, remainder("doc_id", 10) == 0).tree
    texts = [tokens(t) for i, t, _ in rows if not held(i)]
    c = Counter(w for t in texts for w in t)
    often = {w for w, n in c.items() if w and n >= 256}
    assert {"the", "cat", "dog"} <= often == set(tree.words)
    after, plain, total = {}, Counter(), sum(c.values())
    for t in texts:
        own = [END if not w else tree.symbol(w) for w in t]
        plain.update(own)
        for a, b in zip([BEFORE, *own], own):
            after.setdefault(a, Counter())[b] += 1
    want, chances = [], {}
    for a, follow in after.items():
        n = sum(follow.values())
        gain = sum(k * math.log((k / n) / (plain[b] / total)) for b, k in follow.items())
        if n >= 256 and gain - (len(follow) - 1) >= suffix_tree_lm.DIVERGENCE * n:
            want.append(a)
            chances |= {(a, b): (k + 30 * tree.root[b]) / (n + 30) for b, k in follow.items() if k >= 8}
    level = tree.levels[0]
    assert sorted(want) == level.keys.tolist()
    got = {(int(level.keys[e // tree.size]), int(e % tree.size)): p for e, p in zip(level.entries.tolist(), level.chances)}
    assert got == pytest.approx(chances)


def test_tokens_are_written_once_and_not_with_every_level(spark):
    _, docs = table(spark)
    written = []
    with pytest.MonkeyPatch.context() as m:
        for share in ("SYMBOL_SHARE", "CONTEXT_SHARE", "ENTRY_SHARE"):
            m.setattr(suffix_tree_lm, share, 2e-3)
        plain = suffix_tree_lm.materialize
        m.setattr(suffix_tree_lm, "materialize", lambda df, tag: written.append(df.columns) or plain(df, tag))
        model = SuffixTreeModel(docs, remainder("doc_id", 10) == 0)
    assert len(model.levels) >= 2
    assert sum("ids" in columns for columns in written) == 2  # by words, by symbols
