"""run() stage by stage against brute force."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from commlens.llm import mixing, packing
from commlens.llm.common import shared_folder

ALPHABET = {"en": "abcdef", "fr": "ghijkl", "de": "mnopqr", "es": "stuvwx", "junk": "#%&@"}
VILE = ["vile", "nasty", "rotten"]


def corpus():
    """Rows (doc_id, text, lang), labels (doc_id, quality, toxic) and the toxic doc_ids."""
    rng, rows, labels, toxic = random.Random(8), [], [], set()
    words = {x: ["".join(rng.choices(a, k=4)) for _ in range(400)] for x, a in ALPHABET.items()}
    for i in range(600):
        lang = "junk" if i % 10 == 1 else list(ALPHABET)[i % 7 % 4]
        found = rng.choices(words[lang], k=rng.randrange(5, 120))
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(10):
                found.insert(rng.randrange(len(found)), rng.choice(VILE))
        rows.append((i, " ".join(found), "en" if lang == "junk" else lang))
        labels.append((i, int(lang != "junk"), int(i in toxic)))
    for i in range(0, 600, 5):  # unlabelled: equal texts but for case, near copies
        _, text, lang = rows[i]
        rows.append((1000 + i, text.capitalize(), lang))
        rows.append((2000 + i, text + " " + rng.choice(words[lang]), lang))
        if i in toxic:
            toxic |= {1000 + i, 2000 + i}
    rows += [(3000, "good morning", "en"), (3001, "abc <|endoftext|> def", "en"), (3002, None, None)]
    return rows, labels, toxic


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    width = min(5, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set()


def without_near_copies(texts):
    sets, group = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return set(group.values())


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows, labels, toxic = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    top = Path(shared_folder(spark).removeprefix("file:"))
    before = set(top.glob("pipeline-*"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    (folder,) = set(top.glob("pipeline-*")) - before
    stages = [spark.read.parquet(f"{folder}/{k}") for k in range(4)]
    left = [Counter(r.doc_id for r in s.select("doc_id").collect()) for s in stages]
    texts = {i: t for i, t, _ in rows}

    clean = {i: t for i, t in texts.items() if i not in toxic}
    assert left[0] == Counter(clean.keys())
    last = {(t or "").lower(): i for i, t in sorted(clean.items())}
    assert left[1] == Counter(last.values())
    kept = without_near_copies({i: texts[i] for i in last.values()})
    assert left[2] == Counter(kept) and len(kept) < len(last) < len(clean)

    mix = mixing.fit(stages[2], spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), lowest=1.0)
    mixed = mixing.mixed(stages[2], mix).select("doc_id", "_mix.*").collect()
    assert left[3].keys() == kept and max(map(abs, mix.missing)) <= mixing.TOLERANCE
    assert all(abs(left[3][r.doc_id] - r.rate) < 1 + 1e-3 for r in mixed)
    tokens = np.array([left[3][r.doc_id] * r.n_tokens * np.array(r.posteriors) for r in mixed]).sum(axis=0)
    assert np.allclose(tokens / tokens.sum(), list(mixing.TARGETS.values()), atol=0.02)

    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {i: whole.encode(texts[i] or "", add_special_tokens=False).ids + [packing.SEPARATOR] for i in kept}
    pieces.sort(key=lambda r: (r.sequence_id, r.offset))
    packed, at = Counter(), 0
    for r in pieces:
        assert (r.sequence_id, r.offset) == divmod(at, packing.SIZE) and r.length == len(r.ids)
        assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length]
        packed[r.doc_id] += r.start == 0
        at += r.length
    assert packed == left[3] and at == sum(n * len(ids[i]) for i, n in packed.items())
