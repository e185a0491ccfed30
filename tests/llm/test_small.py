"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeated rows, extra columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from commlens.llm import chat, exact, fingerprint, minhash, mixing, packing, pii, substring, toxicity, warc
from commlens.llm.common import WordHashes, words

DOCUMENT = "doc_id long, text string, lang string, source string, digest string, kept string"


def documents(spark, rows):
    """Extra columns carry names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in rows], DOCUMENT)


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def awkward():
    a, b = prose(1, 300), prose(2, 200)
    near = a[:150] + ["changed"] + a[151:]
    rows = [(5, " ".join(a)), (9, " ".join(a).upper()), (7, " ".join(near)), (7, " ".join(near)), (3, " ".join(b + a[40:120]))]
    rows += [(11, None), (12, ""), (13, "  \n\t"), (14, "one two"), (2, "one two"), (15, "É é"), (16, "é é"), (None, "one two"), (None, None)]
    rows += [(20, "go " * 400), (21, "go " * 300), (22, "a b " * 200), (23, "b a " * 200), (24, " ".join(prose(4, 9000)))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, awkward())


def plain_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", plain_lower(text))
    width = min(5, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set()


def test_exact(spark, docs):
    got = sorted(map(tuple, exact.groups(docs).collect()), key=str)
    rows = awkward()
    expected, seen = [], set()
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True):
        same = [j for j, u in rows if plain_lower(u) == plain_lower(t)]
        best = max((j for j in same if j is not None), default=None)
        text = plain_lower(t)
        stays = i == best and text not in seen
        seen |= {text} if stays else set()
        expected.append((i, best, len(same), stays, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    left = exact.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(plain_lower(r.text) for r in left.collect()) == sorted({plain_lower(t) for _, t in rows})


def test_near(spark, docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    rows = awkward()
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((rows[i][0] for i, h in enumerate(group) if h == g and rows[i][0] is not None), default=None) for g in group}
    expected = [(rows[i][0], len(sets[i]), least[g], rows[i][0] == least[g]) for i, g in enumerate(group)]
    assert got == sorted(expected, key=str)


def test_near_chain_needs_no_common_hub(spark):
    base = prose(3, 400)
    texts = [base[: 40 * k] + [f"x{k}{i}" for i in range(20)] + base[40 * k :][20:] for k in range(8)]
    frame = documents(spark, [(100 + k, " ".join(t)) for k, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()}
    sets = [shingle_set(" ".join(t)) for t in texts]
    linked = [all(4 * len(s & t) >= 3 * len(s | t) for t in sets) for s in sets]
    assert all(linked) and set(got.values()) == {100}


def test_near_large_group_against_brute_force(spark):
    """300 near copies of one base that drift, so that few are linked with each other, in few rounds and with no link lost."""
    base = prose(5, 300)
    texts = []
    for k in range(300):
        words = list(base)
        for j in range(2 + k % 9):
            words[(37 * k + 61 * j + k * j) % 300] = f"x{k}y{j}"
        texts.append(" ".join(words[: 300 - k % 40]))
    frame = documents(spark, [(1000 + k, t) for k, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()}
    sets, least = [shingle_set(t) for t in texts], list(range(300))
    pairs = [(a, b) for a in range(300) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for a, b in pairs:
        if least[a] != least[b]:
            low, high = sorted((least[a], least[b]))
            least = [low if x == high else x for x in least]
    assert len(pairs) > 1000 and 1 < len(set(least)) < 290
    assert [got[1000 + k] for k in range(300)] == [1000 + x for x in least]


def test_repeats(spark, docs):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeats(docs).collect()), key=str)
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in awkward()]
    first = {}
    for i, found in rows:
        for k in range(len(found) - 49):
            window = tuple(found[k : k + 50])
            if i is not None:
                first[window] = min(i, first.get(window, i))
    expected = []
    for i, found in rows:
        gone = set()
        for k in range(len(found) - 49):
            if i is not None and first[tuple(found[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        left = " ".join(w for k, w in enumerate(found) if k not in gone)
        expected.append((i, len(found), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    assert got == sorted(expected, key=str)


def test_windows_share_anchors_in_any_context():
    hashes = WordHashes()
    for seed in range(200):
        rng = random.Random(seed)
        vocabulary = rng.choice([2, 5, 50, 5000])
        passage = [b"%d" % rng.randrange(vocabulary) for _ in range(50)]
        found = set()
        for _ in range(4):
            before = [b"%d" % rng.randrange(vocabulary) for _ in range(rng.randrange(80))]
            after = [b"%d" % rng.randrange(vocabulary) for _ in range(rng.randrange(80))]
            found.add(int(substring.anchors(hashes.of(before + passage + after))[len(before)]))
        assert len(found) == 1


def test_personal_data_against_patterns():
    patterns = [
        re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        re.compile(r"[0-9]([\x20-]?[0-9])+"),
        re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]

    def holds(kind, text):
        digits = re.sub("[^0-9]", "", text)
        if kind == 1:
            return all(int(p) <= 255 for p in text.split("."))
        if kind == 2:
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    anchors, rng = pii.automaton(), random.Random(7)
    texts = ["".join(rng.choice("a@.+1 -2(9).%b3 é") for _ in range(rng.randrange(90))) for _ in range(4000)]
    texts += ["mail a.b@c.example.org, 4111 1111 1111 1111 or +49 (30) 1234-5678 at 10.0.0.1", "", "😀 x@y.zz"]
    for text in texts:
        expected = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in p.finditer(text) if holds(k, m[0]))
        assert [s for s in pii.find(text, anchors) if s[1] < 4] == expected
    own = pii.find("see https://a.example/x. IBAN DE89 3704 0044 0532 0130 00!", anchors)
    assert [(k, s) for s, k, _ in own if k > 3] == [(4, 4), (5, 30)]


def test_personal_data_rows(spark):
    frame = documents(spark, [(1, "to x@y.zz now"), (2, None), (None, "10.0.0.1"), (3, "")])
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.spans(frame).collect()}
    assert found == {1: [("email", 3, 9)], 2: [], None: [("ip", 0, 8)], 3: []}
    assert {r.doc_id: r.text for r in pii.redacted(frame).collect()}[1] == "to [email] now"


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    whole.encode_special_tokens = True
    pieces = packing.packed(docs).collect()
    made = {}
    for r in pieces:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        made.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for number, parts in made.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 2048 or number == max(made)
    row = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    everything = [i for r in row for i in r.ids]
    texts = sorted(whole.encode(t or "", add_special_tokens=False).ids + [1] for _, t in awkward())
    cut, start = [], 0
    for r in row:
        if r.start == 0:
            cut.append(everything[start : start + r.doc_tokens])
            start += r.doc_tokens
    assert sorted(cut) == texts and start == len(everything)


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    whole, own, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(5)
    whole.encode_special_tokens = True
    texts = ["İ ΣΑΣ a\x1cb x\xa0y don't I'LL <|endoftext|> 12ab３ ﬁ ß", "中文 😀👍🏽", "'s 's's", "é K"]
    pool = [range(9, 127), range(128, 0x2FF), range(0x300, 0x36F), range(0x1E00, 0x21FF)]
    texts += ["".join(chr(rng.choice(rng.choice(pool))) for _ in range(50)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_markers_get_their_own_ids(spark, tmp_path):
    """The registered query and the pipeline's last stage against the tokenizer as its file has it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import __spark_entry__ as contract
    import corpus_pipeline

    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = ["a<|endoftext|>b", "<|startoftext|> Hi <|endoftext|>", "x <|ENDOFTEXT|> é", "<| endoftext|> <|", "e\u0301 <|endoftext|>\x1c a", "plain"]
    documents(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    expected = {i: whole.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    assert expected[0].count(49407) == 1 and 49406 in expected[1]
    crc = {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in expected.items()}
    rows = contract.queries()["op3_packing"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.ids_crc32, r.doc_tokens) for r in rows} == {i: (crc[i], len(x)) for i, x in expected.items()}
    last = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r.doc_id: list(r.ids) for r in last} == expected


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: 1", "<p>é</p>"), (4, None, "<p>é</p>"), (2, "u", None), (3, "u", ""), (None, "u", "<p>é</p>"), (6, "v", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "archive")
    warc.write_archive(pages, folder)
    got = {r.page_id: r for r in warc.read_archive(spark, folder).collect()}
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    for page_id, _, html in rows:
        body = (html or "").encode()
        best = max(i for i, _, h in rows if i is not None and (h or "") == (html or ""))
        r = got[page_id]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.payload_bytes == len(body)
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == best else ("revisit", best))
    for r in warc.records(spark, folder).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block[length:] == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n") and b"\r\nX: 1" not in head
    warc.write_warc_files(spark, folder, str(tmp_path / "files"))
    assert spark.read.option("wholetext", "true").text(str(tmp_path / "files")).count() > 0
    assert {r.record_type for r in warc.archived(pages, min_revisit=100).collect()} == {"response"}


def test_rotation(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "<|x|>"), (1, 1, "bob", "<|x|>"), (1, None, None, None), (1, 70, "system", "s"), (None, 0, "ann", "q"), (2, 0, "system", "alone")]
    got = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.participant) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    for person in ("ann", "bob", "unknown"):
        turns = sorted((r for r in got if r.conv_id == 1 and r.participant == person), key=lambda r: r.position)
        text = "".join(r.content for r in turns)
        assert [r.position for r in turns] == [1, 2, 3, 4, 5]
        for r in turns:
            assert text[r.start : r.end] == r.content and (r.mask_start is not None) == (r.role == "assistant")
            if r.role == "assistant":
                assert text[r.mask_start : r.mask_end].endswith("<|end|>") and r.name is None
    assert "<|user name=ann|>\nhi<|end|>\n" in {r.content for r in got} and not any("<|x" in r.content for r in got)


def test_fingerprints(spark):
    rows = [(8, " ".join(prose(1, 100))), (6, None), (4, "ab"), (4, "ab"), (9, " ".join(prose(2, 61))), (None, "last"), (1, "x" * 9)]
    got = {(r.doc_id, r.n_chars): r for r in fingerprint.with_edits(documents(spark, rows)).collect()}
    order = [9, 8, 6, 4, 1, None]
    text = {i: t or "" for i, t in rows}
    assert len(got) == 6
    for place, i in enumerate(order):
        own, after = text[i], text[order[(place + 1) % len(order)]]
        half = len(own) // 2
        changed = own[: len(own) - half] + after[:half]
        r, hashes = got[i, len(own)], WordHashes()
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fingerprint.fingerprint(own, hashes) and r.edited_fingerprint == fingerprint.fingerprint(changed, hashes)
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(after, hashes))


def test_likeness_estimates_the_weighted_similarity():
    rng, hashes, error = random.Random(3), WordHashes(), []
    for _ in range(150):
        a = [f"t{rng.randrange(60)}" for _ in range(200)]
        b = a[: rng.randrange(20, 200)] + [f"t{rng.randrange(60)}" for _ in range(60)]
        x, y = ({p: list(zip(t, t[1:])).count(p) for p in set(zip(t, t[1:]))} for t in (a, b))
        keys = {*x, *y}
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
        error.append(fingerprint.likeness(*(fingerprint.fingerprint(" ".join(t), hashes) for t in (a, b))) - true)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.09


def test_segments_against_all_runs():
    """Left to right, the best run, then recursively what lies on both sides of it."""

    def brute(s, low, high):
        runs = [(sum(s[a:b]), -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1) if sum(s[a:b]) > 0]
        if not runs:
            return []
        _, _, a, b = max(runs, key=lambda r: (r[0], r[1], -r[2]))
        return [*brute(s, low, a), (a, b), *brute(s, b, high)]

    rng = random.Random(11)
    for _ in range(300):
        s = [rng.choice([-3.1, -1.7, -0.9, 1.3, 2.2]) + rng.random() / 50 for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(s))] == brute(s, 0, len(s))


def test_toxicity(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        found = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        if toxic := i % 6 == 0:
            for _ in range(4):
                found.insert(rng.randrange(len(found)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(found)))
        labels.append((i, int(toxic)))
    frame = documents(spark, [*rows, (None, "vile nasty rotten vile"), (900, None), (901, "")])
    known = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    score = {r.doc_id: r.score for r in toxicity.scored(frame, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((score[i] >= 0.7) == (i % 6 == 0) for i in held)
    assert score[None] >= 0.7 and score[900] == score[901] < 0.5
    left = toxicity.accepted(frame, model)
    assert left.columns == frame.columns and left.count() == 500 + 2
    assert toxicity.fit(frame, known.where("toxic = 0")).table is None


def test_mixing(spark):
    alphabet = {"en": "abcdef", "fr": "ghijkl", "de": "mnopqr", "es": "stuvwx"}
    rng, rows, labels = random.Random(4), [], []
    for i in range(400):
        lang = list(alphabet)[i % 4]
        text = " ".join("".join(rng.choices(alphabet[lang], k=4)) for _ in range(rng.randrange(1, 60)))
        junk = i % 10 == 0
        rows.append((i, "### %% " * 20 if junk else text, lang))
        labels.append((i, 0 if junk else 1))
    frame = spark.createDataFrame([*rows, (None, None, None), (999, "", "xx")], "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels[:300], "doc_id long, quality int")
    for lowest in (0.0, 1.0):
        mix = mixing.fit(frame, known, lowest=lowest)
        found = mixing.mixed(frame, mix).select("_mix.*").collect()
        p, n, rate = (np.array([r[c] for r in found]) for c in ("posteriors", "n_tokens", "rate"))
        expected = (p * (n * rate)[:, None]).sum(axis=0)
        assert np.allclose(expected / expected.sum(), list(mixing.TARGETS.values()), atol=0.01) and rate.min() >= lowest
    again = mixing.resampled(frame, mix)
    assert again.columns == frame.columns and again.select("doc_id").distinct().count() == frame.count()


@pytest.mark.parametrize("letters", [3, 12])
def test_mixing_meets_far_targets(spark, letters):
    """One domain at 90 %, one at 0.1 %, posteriors clear or not (few letters), no document lost."""
    alphabet = {"en": "abcdef", "fr": "efghij", "de": "ijklmn", "es": "mnopqa", "junk": "#%&a"}
    rng, rows, labels = random.Random(7), [], []
    for i in range(4000):
        place = i % 1000
        lang = "en" if place < 900 else "fr" if place < 950 else "de" if place < 990 else "es" if place < 999 else "junk"
        text = " ".join("".join(rng.choices(alphabet[lang], k=letters)) for _ in range(rng.randrange(1, 6)))
        rows.append((i, text, "en" if lang == "junk" else lang))
        labels.append((i, int(lang != "junk")))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mix = mixing.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int"), lowest=1.0)
    found = mixing.mixed(frame, mix).select("_mix.*").collect()
    p, n, rate = (np.array([r[c] for r in found]) for c in ("posteriors", "n_tokens", "rate"))
    expected = (p * (n * rate)[:, None]).sum(axis=0)
    left = np.array(list(mixing.TARGETS.values())) - expected / expected.sum()
    assert np.abs(left).max() <= mixing.TOLERANCE * 1.01 and rate.min() >= 1
    assert np.allclose(left, mix.missing, atol=1e-6)


def test_mixing_against_projected_gradient(spark):
    """Rates equal those of plain projected gradient steps on every document's rate, run until they stand still."""
    alphabet = {"en": "abcdef", "fr": "efghij", "de": "ijklmn", "es": "mnopqa", "junk": "#%&a"}
    rng, rows, labels = random.Random(11), [], []
    for i in range(400):
        lang = list(alphabet)[min(i % 8, 4)]
        rows.append((i, " ".join("".join(rng.choices(alphabet[lang], k=5)) for _ in range(rng.randrange(1, 30))), "en" if lang == "junk" else lang))
        labels.append((i, int(lang != "junk")))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mix = mixing.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = mixing.mixed(frame.repartition(7), mix).select("_mix.*").collect()
    p, n, rate = (np.array([r[c] for r in found]) for c in ("posteriors", "n_tokens", "rate"))
    aim, plain = np.array(list(mixing.TARGETS.values())), np.ones(len(n))
    share = n / n.sum()
    step = 1 / np.linalg.eigvalsh((p * share[:, None]).T @ p).max()
    for _ in range(30_000):
        plain = np.maximum(0, plain - step * p @ ((plain * share) @ p - aim))
    assert np.abs((plain * share) @ p - aim).max() < 1e-6
    # both meet the targets; steps from 1 that are cut at 0 end near, not at, the nearest such rates
    assert share @ (rate - 1) ** 2 <= share @ (plain - 1) ** 2 + 1e-4 and share @ (rate - plain) ** 2 < 0.01


def test_mixing_reports_what_it_cannot_meet(spark):
    """Without a document in Spanish the others keep their proportions, and the share of Spanish is reported."""
    rows = [(i, "abc abd " * 5 if i % 3 else "xyz xxy " * 5, "en" if i % 3 else "fr") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    for lowest in (0.0, 1.0):
        mix = mixing.fit(frame, known, {"en": 0.4, "fr": 0.4, "es": 0.2}, lowest=lowest)
        assert np.allclose(mix.missing, [-0.1, -0.1, 0.2], atol=1e-3)
    assert np.allclose(mixing.fit(frame, known.limit(0), {"en": 0.7, "fr": 0.3}).missing, [0.2, -0.2])


def test_empty_tables(spark):
    none, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert exact.groups(none).count() == 0 and exact.deduplicated(none).count() == 0
    assert packing.packed(none).count() == 0 and pii.spans(none).count() == 0
    assert substring.repeats(none).count() == 0 and fingerprint.with_edits(none).count() == 0
    assert minhash.kept(none).count() == 0
    assert toxicity.accepted(none, toxicity.fit(none, labels)).count() == 0
    assert mixing.resampled(none, mixing.fit(none, labels)).count() == 0
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert words(None) == []
