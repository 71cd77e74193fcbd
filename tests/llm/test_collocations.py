import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from webcatalog.llm import collocations
from webcatalog.llm.common import ready

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def text_rows(seed=3, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "Été", "new", "york", "city", "of", "x" * 50, "und"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "; "]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text + rng.choice(["", " New York City Hall", " new york city of"]), "phrase", 1))
    return [*rows, ("en", None, None, 1), ("de", "", None, 1), *[("fr", "only words here", None, 2)] * 31]


def found(spark, rows, **options):
    docs = ready(spark).createDataFrame(rows, "lang string, text string, phrase string, f int").repartition(5)
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


@pytest.mark.parametrize("options", [{}, {"limit": 40, "burst": 3}])
def test_matches_brute_force(spark, options):
    rows = text_rows()
    assert found(spark, rows, min_count=5, top=12, **options) == brute(rows, 5, 12)


def test_default_threshold_and_small_steps(spark):
    rows = text_rows(7, 200)
    assert found(spark, rows) == brute(rows, 30, 2000) != []


def test_empty_and_rare(spark):
    assert found(spark, []) == [] and found(spark, [("en", None, None, 1), ("en", "a b c", None, 1)]) == []


def test_trie_bursts_and_spills_whole_subtrees():
    trie, want, rng = collocations.HatTrie(burst=4), Counter(), random.Random(1)
    out = Counter()
    for _ in range(3000):
        first, tail = rng.randrange(6), rng.randrange(1, 9) | rng.choice([0, rng.randrange(1, 5)]) << collocations.WORD_BITS
        trie.add(first, tail)
        want[first, tail] += 1
        if trie.entries >= 60:
            for head, tails in trie.spill(30):
                assert head not in trie.root
                out.update({(head, t): c for t, c in tails})
    assert any(type(x) is collocations.Node for x in trie.root.values())
    for head, tails in trie.spill(0):
        out.update({(head, t): c for t, c in tails})
    assert out == want and trie.entries == 0


def test_bitmap_has_every_hash(spark):
    rows = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 6000)
    known = collocations.bitmap(ready(spark).createDataFrame([(int(h),) for h in rows[:3000]], "h long"))
    found = known.has(rows.view(np.uint64))
    assert found[:3000].all() and found[3000:].sum() < 600


def test_words_hash_as_in_spark(spark):
    words = collocations._Words(None)
    words.ids("de", ["über".encode(), b"."])
    row = spark.sql("SELECT xxhash64(concat('de', '\\0', 'über')) AS h").first()
    assert np.array(words.hash, np.uint64).view(np.int64).tolist() == [row.h]


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 7)  # goes along with the function
    monkeypatch.setattr(collocations, "HASHES", 11)
    monkeypatch.setattr(collocations, "HELD", 5)
    rows = text_rows(11, 120)
    assert found(spark, rows, min_count=4, limit=30) == brute(rows, 4, 2000)


def test_long_text(spark):
    rows = [("en", "alpha beta gamma " * 20_000, None, 1), ("en", "solo", None, 1)]
    got = found(spark, rows, min_count=30)
    assert got == brute(rows, 30, 2000)
