"""Repeated passages against brute force: hot passages, few different words, long runs, passages just below and above a window."""

import hashlib
import random

import pytest

from commlens.llm import substring
from commlens.llm.common import WordHashes


def plain(rows):
    """doc_id, n_words, n_removed, kept_sha256 of rows (doc_id, words)."""
    size, first, out = substring.SIZE, {}, []
    for i, found in rows:
        for k in range(len(found) - size + 1):
            window = tuple(found[k : k + size])
            first[window] = min(i, first.get(window, i))
    for i, found in rows:
        gone = set()
        for k in range(len(found) - size + 1):
            if first[tuple(found[k : k + size])] < i:
                gone.update(range(k, k + size))
        left = " ".join(w for k, w in enumerate(found) if k not in gone)
        out.append((i, len(found), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [2, 30, 5000])
def test_planted_passages(spark, monkeypatch, vocabulary):
    """One passage in half of the documents, so that its digests are joined by broadcast."""
    monkeypatch.setattr(substring, "HOT", 10)
    rng = random.Random(vocabulary)

    def prose(n):
        return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]

    passages = [prose(n) for n in (49, 50, 51, 54, 64, 130, 300)] + [["go"] * 200, ["a", "b"] * 100]
    rows = []
    for i in range(240):
        found = prose(rng.randrange(120))
        if i % 2:
            found += passages[4] + prose(rng.randrange(40))
        if i % 5 == 0:
            passage = rng.choice(passages)
            low = rng.randrange(len(passage) // 3)
            found += passage[low:] + prose(rng.randrange(30))
        rows.append((7 * i % 240, found))
    frame = spark.createDataFrame([(i, " ".join(w), "x", 1) for i, w in rows], "doc_id long, text string, stretch string, row int")
    got = substring.repeats(frame.repartition(5)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    expected = plain(rows)
    assert sorted(map(tuple, got)) == expected and sum(r[2] > 0 for r in expected) > 80


def test_parsed_together_or_alone():
    hashes, rng = WordHashes(), random.Random(9)
    texts = [[b"%d" % rng.randrange(rng.choice([1, 3, 900])) for _ in range(rng.randrange(50, 300))] for _ in range(40)]
    parts = [hashes.of(t) for t in texts]
    for part, together in zip(parts, substring.anchors_of(parts), strict=True):
        assert (substring.anchors(part) == together).all()
