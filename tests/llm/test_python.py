"""The operators that SQL can't express, against libraries, brute force and round trips."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from panelforge.llm import bpe, licenses, media, ngram_join, packing, suffix_dedup, toxicity
from panelforge.llm.queries import vocabulary

from tests.llm import fixtures

SF = "/root/testdata/sf0.01"


def by_id(df, *names):
    return sorted([tuple(r[n] for n in ("doc_id", *names)) for r in df.collect()], key=str)


# Toxicity


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.toxicity_scores(docs, labels).toPandas()
    marked = r.merge(labels.toPandas(), on="doc_id")
    assert len(r) == docs.count() and r.score.between(0, 1).all() and ((r.score >= 0.5) == (r.predicted == 1)).all()
    held = marked[marked.held_out]
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert auc > 0.8 and (neg >= 0.5).mean() < 0.05


def test_pairs_weigh_more_than_their_terms():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([i for i, on in enumerate((a, b, True)) if on]))
        y.append(float(a and b))
    m = toxicity._learn(rows, np.array(y), np.arange(3), toxicity.Settings(epochs=30))
    s = m.score([[0, 1, 2], [0, 2], [1, 2], [2]])
    assert s[0] > 0.8 and max(s[1:]) < 0.2


def test_scores_are_the_sum_over_all_pairs():
    rng = np.random.default_rng(5)
    m = toxicity.Model(np.arange(12), -0.3, rng.normal(size=12), rng.normal(size=(12, 4)), 20)
    rows = [[], [3], [0, 5], [1, 2, 7, 11], list(range(12))]
    want = [-0.3 + sum(m.weight[i] for i in r) + sum(m.factor[i] @ m.factor[j] for i in r for j in r if i < j) for r in rows]
    assert np.allclose(m.score(rows), 1 / (1 + np.exp(-np.array(want))))


def test_words_that_tell_only_in_pairs(spark):
    """Each of four words is in half of the rows of either label; ids are strings. Only pairs tell, and no additive weights can."""
    rng, rows = random.Random(6), []
    for i in range(1600):
        a, b = rng.choice(["zorb", "vint"]), rng.choice(["quill", "mast"])
        noise = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(25)]
        rows.append((f"d{i}", " ".join(noise[:12] + [a, b] + noise[12:]), int((a == "zorb") == (b == "quill"))))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id string, quality int, toxic int")

    def auc(settings):
        truth = {i: y for i, _, y in rows}
        held = [(r.score, truth[r.doc_id]) for r in toxicity.toxicity_scores(docs, labels, settings).filter("held_out").collect()]
        pos, neg = (np.array([s for s, y in held if y == k]) for k in (1, 0))
        return (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()

    small = {"features": 64}
    assert auc(toxicity.Settings(**small)) > 0.95
    assert auc(toxicity.Settings(**small, pairs=0)) < 0.7


def test_toxicity_of_awkward_rows(spark):
    docs = fixtures.docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (4, 1, None), (12, 1, 1), (13, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == docs.count()
    assert toxicity.toxicity_scores(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


# Packing


def test_best_fit_against_a_plain_search():
    rng = random.Random(2)
    for _ in range(50):
        sizes, length = [rng.randrange(0, 40) for _ in range(rng.randrange(0, 60))], 50
        rows, room = [], []
        for i in sorted((i for i, n in enumerate(sizes) if n), key=lambda i: (-sizes[i], i)):
            fit = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
            k = min(fit)[1] if fit else len(rows)
            if not fit:
                rows.append([]), room.append(length)
            rows[k].append(i)
            room[k] -= sizes[i]
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for r in got for i in r) == [i for i, n in enumerate(sizes) if n] and all(sum(sizes[i] for i in r) <= length for r in got)
        assert sorted(sorted(sizes[i] for i in r) for r in got) == sorted(sorted(sizes[i] for i in r) for r in rows)


def test_packing_is_lossless(spark, tmp_path):
    docs = fixtures.docs(spark)
    seen, length = {}, 64
    for r in packing.pack(docs, length=length, shards=2).collect():
        ids, pos = np.frombuffer(r.ids, np.uint16), np.frombuffer(r.positions, np.uint16)
        assert len(ids) == length and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 0).all()
        for a, b, i, p in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.parts):
            assert (pos[a:b] == np.arange(b - a)).all()
            seen.setdefault((i, p), []).append(ids[a:b].tobytes())
    expected = {}
    for i, t, *_ in fixtures.rows():
        ids = packing.byte_tokens(t or "")
        for p in range(-(-len(ids) // length)):
            expected.setdefault((i, p), []).append(ids[p * length : (p + 1) * length].tobytes())
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in expected.items()}
    assert packing.pack(docs.limit(0)).count() == 0
    packing.write_packed(packing.pack(docs, length=length, shards=2), str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == packing.pack(docs, length=length, shards=2).count()


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_is_the_librarys(spark, library):
    rows = fixtures.rows() + [(9000 + r.doc_id, r.text, None, None, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = fixtures.docs(spark, rows)
    expected = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert by_id(bpe.token_digests(docs, vocabulary()), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)
    tokens = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    assert all(r.decoded == library.decode(list(r.token_ids), skip_special_tokens=False) for r in tokens.collect())
    assert bpe.encode(docs.limit(0), vocabulary()).count() == 0


def test_digested_texts_are_decoded_from_ids(monkeypatch):
    made = bpe.WordBpe(vocabulary(), as_text=True)
    monkeypatch.setattr(made, "decode", lambda ids: " ".join(map(str, ids)))
    for pieces in made.encode(["some words, decoded", "again words <|x|>"]):
        assert pieces and all(p[2] == p[1] for p in pieces)


def test_last_stage_gives_the_decoded_text(spark, library):
    import corpus_pipeline

    rows = corpus_pipeline.encode(spark, fixtures.docs(spark), SF).collect()
    assert rows and all(r.decoded == library.decode(list(r.token_ids), skip_special_tokens=False) for r in rows)


def test_unsafe_merges_follow_the_order_of_places(library):
    made = bpe.WordBpe(vocabulary())
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("aabbcdeinotrs") for _ in range(rng.randrange(1, 40)))
        assert made.ids(w) == library.encode(w, add_special_tokens=False).ids


def test_words_of_any_length(library):
    """A million letters without a space take seconds; the lists by rank give what rounds give."""
    made, rng = bpe.WordBpe(vocabulary()), random.Random(2)
    for w in ["a" * 777, "ab" * 500, "aab" * 333, "日本語" * 400, "".join(rng.choice("etaoinshr") for _ in range(3000))]:
        assert made.ids(w) == made.ids(w) == library.encode(w, add_special_tokens=False).ids
        assert made.merge_long(w.encode()) == made.merge_rounds([w.encode()])[0]
    for _ in range(200):
        w = "".join(rng.choice("aabbcdeinotrs") for _ in range(rng.randrange(1, 40)))
        assert made.merge_long(w.encode()) == made.merge_rounds([w.encode()])[0]
    w = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    began = time.time()
    ids = made.ids(w)
    assert time.time() - began < 60 and ids == library.encode(w, add_special_tokens=False).ids


# Media


def test_equal_texts_have_equal_values_in_any_batch(spark):
    rng = random.Random(5)
    texts = [fixtures.sentence(rng, rng.randrange(1, 400)) for _ in range(40)]
    alone = {t: media.decode(media.encode([media.payload_of(t)]))[0] for t in texts}
    for _ in range(3):
        rng.shuffle(texts)
        for t, (payload, rgb) in zip(texts, media.decode(media.encode([media.payload_of(t) for t in texts]))):
            assert payload == alone[t][0] == media.payload_of(t) and (rgb == alone[t][1]).all()
    docs = fixtures.docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts * 2)])
    for r in media.media_columns(docs).collect():
        payload, rgb = alone[texts[r.doc_id % 40]]
        (file,) = media.encode([payload])
        plain = ",".join(f"{rgb[..., c].mean():.2f}/{rgb[..., c].astype(float).std():.2f}" for c in range(3))
        assert (r.feature, r.tail_crc32) == (f"{rgb.shape[0]}x{rgb.shape[1]}:{plain}", zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


def test_media_round_trip(spark):
    got = by_id(media.media_columns(fixtures.docs(spark)), "n_bytes", "payload_bytes", "payload_sha256")
    expected = []
    for i, t, *_ in fixtures.rows():
        p = media.payload_of(t or "")
        expected.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest()))
    assert got == sorted(expected, key=str)
    assert media.media_columns(fixtures.docs(spark).limit(0)).count() == 0


def test_every_scan_form_survives():
    rng = random.Random(3)
    payloads = [bytes(rng.randrange(256) for _ in range(192 * k)) for k in (1, 2, 7, 33)]
    payloads += [bytes([128]) * 768, bytes(rng.choice([128] * 40 + [127, 129, 1, 255]) for _ in range(192 * 9)), bytes([129]) * 192]
    assert [p for p, _ in media.decode(media.encode(payloads))] == payloads


def test_pixels_agree_with_an_independent_reader(spark):
    payload = b"The quick brown fox jumps over the lazy dog. " * 40
    payload += b" " * (-len(payload) % 192)
    # Values near the middle keep the picture inside 0 to 255, so that clipping can't hide differences.
    payload = bytes(128 + (b - 96) // 16 for b in payload)
    (file,) = media.encode([payload])
    ((_, rgb),) = media.decode([file])
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(file)))
    assert (image.getHeight(), image.getWidth()) == rgb.shape[:2]
    flat = np.array(image.getRGB(0, 0, image.getWidth(), image.getHeight(), None, 0, image.getWidth())).reshape(rgb.shape[:2])
    other = np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], -1)
    assert np.abs(other - rgb.astype(int)).mean() < 6  # readers differ in how they upsample chroma


def test_tensors_column(spark):
    r = media.media_columns(fixtures.docs(spark).filter("doc_id = 4").limit(1), tensors=True).first()
    assert len(r.rgb) == r.height * r.width * 3 and bytes(r.media[:2]) == b"\xff\xd8" and len(r.media) == r.media_bytes


# Licenses


def test_license_bases_by_brute_force(spark):
    expected = []
    for i, t, *_ in fixtures.rows():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for p, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in hits]
        expected.append((i, len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in hits}))))
    got = licenses.scan_licenses(fixtures.docs(spark))
    assert by_id(got, "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(expected, key=str)
    assert got.filter("NOT score BETWEEN 0 AND 1").count() == 0
    assert licenses.scan_licenses(fixtures.docs(spark).limit(0)).count() == 0


def test_templates_accept_exact_mandatory_wording():
    a = licenses.Automaton("licensed under <<optional>> the <</optional>> x <<any:1-2>> end")
    words = lambda s: s.encode().split()
    assert a.length_at(words("licensed under x one end"), 0) == 5
    assert a.length_at(words("licensed under the x one two end more"), 0) == 7
    assert a.length_at(words("licensed under x end"), 0) == 0
    assert a.length_at(words("licensed under x one two three end"), 0) == 0
    assert a.length_at(words("licensed beneath x one end"), 0) == 0


    free = licenses.Automaton("<<any:1-2>> x end")
    assert licenses.template_matches(words("foo x end"), [("q", free)]) == [("q", 0, 3)]
    for wrong in ("a <<optional>> b", "a <</optional>>", "a <<some>> b"):
        with pytest.raises(ValueError):
            licenses.Automaton(wrong)


def plain_expression(markup):
    """The template as a regular expression over words, each followed by a space."""
    out = []
    for part in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if part == "<<optional>>":
            out.append("(?:")
        elif part == "<</optional>>":
            out.append(")?")
        elif part.startswith("<<any:"):
            out.append(r"(?:[^ ]+ ){%s,%s}" % tuple(part[6:-2].split("-")))
        else:
            out += [w + " " for w in re.findall("[a-z0-9]+", part.lower())]
    return re.compile("".join(out))


def filled(markup, rng):
    text = re.sub(r"<<optional>>(.*?)<</optional>>", lambda m: m[1] if rng.random() < 0.5 else "", markup, flags=re.S)
    return re.sub(r"<<any:(\d+)-(\d+)>>", lambda m: " ".join(["owner"] * rng.randrange(int(m[1]), int(m[2]) + 1)), text)


def test_labels_of_templates_by_regular_expressions(spark):
    rng, rows = random.Random(7), []
    for label, markup in licenses.TEMPLATES * 4:
        words = filled(markup, rng).split()
        rows.append(" ".join(["see", *words, "thanks"]))
        words[rng.randrange(len(words))] = "altered"
        rows.append(" ".join(words))
    got = {r.doc_id: r for r in licenses.scan_licenses(fixtures.docs(spark, [(i, t, None, None, None) for i, t in enumerate(rows)])).collect()}
    for i, text in enumerate(rows):
        joined = " ".join(re.findall("[a-z0-9]+", text.lower())) + " "
        names = {label for label, markup in licenses.TEMPLATES if re.search("(?<![^ ])" + plain_expression(markup).pattern, joined)}
        assert set(got[i].labels.split(",")) - {""} == names | (set(got[i].base_labels.split(",")) - {""}), text
        assert got[i].score == (1.0 if any(n.endswith("-text") for n in names) else 0.75 if names else 0.5 if got[i].base_labels else 0.0)
    assert sum(r.score == 1.0 for r in got.values()) >= 20


# N-gram join


def brute_links(rows):
    def grams(text):
        words = re.split("[ \t-\r\x1c-\x1f]+", text or "")
        words = [w for w in words if w]
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [grams(t) for _, t, *_ in rows]
    links = [[] for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if len(a) and len(sets[j]) and both * 10 >= 8 * (len(a) + len(sets[j]) - both):
                links[i].append(j), links[j].append(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((row[0], min(ids) if ids else None, len(seen), len(links[i])))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1024, 2])
def test_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = ngram_join.jaccard_classes(fixtures.docs(spark))
    assert by_id(got, "class_id", "class_size", "n_links") == brute_links(fixtures.rows())


def test_near_copies_of_a_large_group(spark):
    rng = random.Random(9)
    base = fixtures.sentence(rng, 200).split()
    rows = [(i, " ".join("new" + str(rng.randrange(9)) if rng.random() < rng.choice([0.004, 0.02]) else w for w in base), None, None, None) for i in range(150)]
    assert by_id(ngram_join.jaccard_classes(fixtures.docs(spark, rows)), "class_id", "class_size", "n_links") == brute_links(rows)


def test_near_copies_among_texts_of_shared_lines(spark):
    rng = random.Random(4)
    lines = [f"line{i}" for i in range(240)]
    texts = [rng.sample(lines, 100) for _ in range(6000)]
    for k in range(0, 400, 2):  # 90 of 100 lines shared: 90 / 110 > 0.8
        texts[k + 1] = texts[k][:90] + rng.sample(sorted(set(lines) - set(texts[k])), 10)
    rows = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    on = np.array([[x in t for x in lines] for t in map(set, texts)], np.float32)
    both = on @ on.T
    want = ((both / (200 - both) >= 0.8).sum(1) - 1).tolist()
    got = by_id(ngram_join.jaccard_classes(fixtures.docs(spark, rows), n=1), "n_links")
    assert sum(want) >= 400 and sorted(got) == list(enumerate(want))


def test_leaders_speak_for_all_that_are_near():
    """Whatever the pieces, two sets within reach of linked ones end up in one component."""
    rng = np.random.default_rng(3)
    far, steps = ngram_join.reach(0.8, 0.99999), ngram_join.levels(5, 12)
    assert far == 51 + 2 * sum(ngram_join.SETTLES) and [s[0] for s in steps] == [12, 8, 5]
    strangers = rng.integers(0, 256, (300, ngram_join.SKETCH), dtype=np.uint8)
    near = strangers.copy()
    near[:, rng.permutation(ngram_join.SKETCH)[:51]] ^= 1
    close = strangers.copy()
    close[:, :4] ^= 1
    sketches = np.concatenate([strangers, near, close])
    rest = rng.integers(0, 3, (900, 7), dtype=np.uint8)
    order = np.lexsort(rest.T[::-1])
    ties, leaders = ngram_join.matched([bytes(8) + rest[k].tobytes() for k in order], sketches[order], steps, far)
    up = {k: {k} for k in range(900)}
    for a, b in ties:
        a, b = order[a], order[b]
        up[a] |= up[b]
        for k in up[a]:
            up[k] = up[a]
    assert all({k + 300, k + 600} <= up[k] for k in range(300)) and max(map(len, up.values())) == 3
    assert len(leaders) < 900


@pytest.mark.parametrize("piece", [2048, 3])
def test_recall_in_crowded_nodes(spark, monkeypatch, piece):
    """Near copies of similarity 0.8 to 0.95 among texts that share most of a boilerplate passage, against all pairs."""
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    texts = [common + [f"w{rng.randrange(10**6)}" for _ in range(140)] for _ in range(700)]
    for k in range(0, 500, 2):
        changed = rng.choice([1, 2, 3, 4])
        words = list(texts[k])
        for at in rng.sample(range(len(words)), changed):
            words[at] = f"n{rng.randrange(10**6)}"
        texts[k + 1] = words
    rows = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    want = brute_links(rows)
    assert sum(r[3] for r in want) > 350
    assert by_id(ngram_join.jaccard_classes(fixtures.docs(spark, rows)), "class_id", "class_size", "n_links") == want


def test_classes_hold_together_inside_a_tile():
    """Links A-X, A-Z, B-Y and B-Z, with A and B in one block: one class, though Z is the first partner of neither."""
    a, b, x, y, z = (np.arange(k, k + 100, dtype=np.uint64) for k in (50, 72, 39, 83, 61))
    linked, label = ngram_join._links([a, b, x, y, z], np.ones(5, np.int64), np.arange(2), np.arange(2, 5), False, 0.8)
    assert label.tolist() == [0] * 5 and linked.tolist() == [2, 2, 1, 1, 2]


def test_depth_follows_the_recall():
    assert ngram_join.depth_for(0.8, 32, 12, 0.99999) == 5
    assert ngram_join.depth_for(0.8, 32, 12, 0.5) > 5
    assert ngram_join.depth_for(0.8, 1, 4, 0.99999) == 1


def test_join_of_an_empty_table(spark):
    assert ngram_join.jaccard_classes(fixtures.docs(spark).limit(0)).count() == 0
    kept = ngram_join.representatives(fixtures.docs(spark))
    assert kept.columns == fixtures.docs(spark).columns


# Suffix dedup


def brute_removal(texts):
    starts = {}
    for t in texts:
        for i in range(len(t) - 199):
            starts[t[i : i + 200]] = starts.get(t[i : i + 200], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if starts[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("giant, least", [(50_000, 20), (1, 1), (50_000, 2)], ids=["usual", "dealt by window", "all frequent"])
def test_removal_against_all_strings(spark, monkeypatch, giant, least):
    monkeypatch.setattr(suffix_dedup, "GIANT", giant)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", least)
    monkeypatch.setattr(suffix_dedup, "HINT", 1 if least < 20 else 64)
    expected = [(r[0], *x) for r, x in zip(fixtures.rows(), brute_removal([(t or "").encode() for _, t, *_ in fixtures.rows()]))]
    got = suffix_dedup.removal_digests(fixtures.docs(spark))
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=str)


def test_texts_whose_keys_collide(spark, monkeypatch):
    real = suffix_dedup.text_key
    monkeypatch.setattr(suffix_dedup, "text_key", lambda text, seed=0: real(text, seed) % 5 if seed < 2 else real(text, seed))
    expected = [(r[0], *x) for r, x in zip(fixtures.rows(), brute_removal([(t or "").encode() for _, t, *_ in fixtures.rows()]))]
    assert by_id(suffix_dedup.removal_digests(fixtures.docs(spark)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=str)


def test_texts_longer_than_a_stretch(monkeypatch):
    powers = suffix_dedup._powers()
    raw = bytes(random.Random(1).randrange(256) for _ in range(5000))
    whole = list(suffix_dedup.anchors_of(raw, powers))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    parts = list(suffix_dedup.anchors_of(raw, suffix_dedup._powers()))
    starts = lambda got: [(int(g), int(f) + k) for gram, first, n in got for g, f, m in zip(gram, first, n) for k in range(m)]
    assert starts(parts) == starts(whole) and len(starts(whole)) == len(raw) - 199


def test_removal_of_an_empty_table(spark):
    assert suffix_dedup.removal_digests(fixtures.docs(spark).limit(0)).count() == 0


def test_general_output_has_texts_and_runs(spark):
    r = suffix_dedup.remove_repeats(fixtures.docs(spark)).filter("doc_id = 8").first()
    assert r.n_bytes - r.n_removed == len(r.kept) and sum(x.stop - x.first for x in r.removed) == r.n_removed


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(2, 9)] + [(20, 30), (20, 31), (31, 20), (33, 32), (32, 20)]])
def test_components_of_chains_and_stars(spark, edges):
    """Every node has the smallest that it reaches, and the rounds' tables are gone."""
    from pathlib import Path

    tables = lambda: set(Path(spark.conf.get("spark.checkpoint.dir")).glob("scratch-*"))
    before = tables()  # of results of other operators, which are read when they are asked for
    given = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(given).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: 2 if x < 20 else 20 for x in nodes}
    assert tables() == before


def test_bpe_of_every_character():
    """Composed, classed and split as in the library, whatever version of Unicode its tables have."""
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary()), bpe.load(vocabulary())
    characters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    later = [c for c in characters if own.later.search(c)]
    for group in (sorted(set(characters) - set(later)), later[::11], [c for c in later if c.isalnum() or c < "\u2100"]):
        for at in range(0, len(group), 2000):
            text = " ".join(f"e{c}\u0301 a{c}1{c}B" for c in group[at : at + 2000])
            assert own.ids(text) == library.encode(text, add_special_tokens=False).ids


# Ids and other columns


IDS = {fixtures.BIG, fixtures.BIG + 2, None, 4}


@pytest.mark.parametrize(
    "run",
    [
        lambda d, labels: toxicity.toxicity_scores(d, labels),
        lambda d, labels: bpe.token_digests(d, vocabulary()),
        lambda d, labels: media.media_columns(d),
        lambda d, labels: licenses.scan_licenses(d),
        lambda d, labels: ngram_join.jaccard_classes(d),
        lambda d, labels: suffix_dedup.remove_repeats(d),
    ],
    ids=["toxicity", "bpe", "media", "licenses", "ngram_join", "suffix_dedup"],
)
def test_ids_beside_null(spark, run):
    labels = spark.createDataFrame([(fixtures.BIG, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = run(fixtures.beside_null(spark), labels).collect()
    assert {r.doc_id for r in rows} == IDS and len(rows) == 4
    if "class_id" in rows[0]:
        assert {r.class_id for r in rows} <= IDS


def test_packed_ids_beside_null(spark):
    rows = packing.pack(fixtures.beside_null(spark), length=64).collect()
    assert {i for r in rows for i in r.doc_ids} == IDS - {4}


def test_stages_keep_columns_of_all_types(spark):
    import corpus_pipeline

    docs = fixtures.beside_null(spark)
    want = {r.doc_id: r for r in docs.selectExpr("doc_id", *[f"CAST({c} AS string) AS {c}" for c in docs.columns[4:]]).collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.selectExpr("doc_id", *[f"CAST({c} AS string) AS {c}" for c in docs.columns[4:]]).collect()
        assert rows and all(r == want[r.doc_id] for r in rows), name
