"""Operators on odd rows, on empty tables and against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_cases import brute_windows, feistel
from pyspark.sql import functions as F

from lociweave.llm import feistel_pii, fm_decontam, golay_simhash, license_digest, media_sniff, ordinal_quality, pivotal_mix, slot_sharding, toxicity_kn, url_asof


def as_rows(df):
    return Counter((r["doc_id"]) for r in df.collect())


# ---------------------------------------------------------------- all operators


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(60)] + [(None, 1, 1), (7, None, None), (8, 5, 5)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark, odd):
    text = odd.filter("doc_id = 3").first()["text"]
    return spark.createDataFrame([(1, text), (2, "x"), (3, None), (None, "w1"), (4, ""), (2, "漢字 text")], "item_id long, text string")


def captures_of(docs):
    """Documents as captures: very long, empty and null URLs, ties in time, clashing columns."""
    url = F.when(F.col("text") == "", F.col("text")).otherwise(F.concat(F.lit("http://a.b.org/"), F.col("text")))
    when = F.when(F.col("source").isNotNull(), F.timestamp_seconds(F.coalesce(F.col("doc_id"), F.lit(0)) % 7))
    return docs.withColumn("page_id", F.col("doc_id")).withColumn("url", url).withColumn("fetched_at", when).withColumn("host", F.lit("x")).withColumn("action", F.lit("y")).withColumn("_part", F.lit(1)).withColumn("entry", F.lit(1))


def entries_of(spark):
    return spark.createDataFrame([("b.org", 3, "block"), ("b.org", 3, "allow"), ("b.org", 3, "block"), ("a.b.org", 5, "allow"), (None, 1, "block")], "host string, t long, action string").select("host", F.timestamp_seconds("t").alias("effective_at"), "action", F.lit(0).alias("own_host"))


def operators(spark, docs, labels, benchmark):
    ratings = labels.select("doc_id", (F.col("quality") + F.col("toxic")).alias("grade"))
    return {
        "op1": ordinal_quality.quality(docs, ordinal_quality.fit(docs, ratings, 3, rounds=3)),
        "op2": url_asof.filter_captures(captures_of(docs), entries_of(spark)).withColumnRenamed("page_id", "doc_id"),
        "op3": toxicity_kn.toxicity(docs, toxicity_kn.fit(docs, labels)),
        "op4": license_digest.license_scan(docs),
        "op5": media_sniff.sniff(media_sniff.text_media(docs)),
        "op6": pivotal_mix.mix(docs),
        "op7": fm_decontam.contamination(docs, benchmark),
        "op8": golay_simhash.near_duplicates(docs),
        "op9": feistel_pii.pseudonymise(docs, KEY),
        "op10": slot_sharding.shard_documents(docs),
    }


def test_every_row_comes_back(spark, odd, labels, benchmark):
    want = as_rows(odd)
    for name, out in operators(spark, odd, labels, benchmark).items():
        assert as_rows(out) == want, name


def test_empty_tables(spark, none, odd, labels, benchmark):
    for name, out in operators(spark, none, labels, benchmark.limit(0)).items():
        assert out.count() == 0, name
    for out in operators(spark, odd.limit(5), labels.limit(0), benchmark.limit(0)).values():
        assert out.count() == 5


def test_filtering_stages_keep_columns_and_empty_tables(spark, none, odd, labels, benchmark):
    model = toxicity_kn.fit(odd, labels)
    for docs in (odd, none):
        for out in (toxicity_kn.drop_toxic(docs, model), golay_simhash.keep_one(docs), fm_decontam.drop_contaminated(docs, benchmark), pivotal_mix.mixed_documents(docs)):
            assert out.columns == docs.columns
            assert out.count() <= 3 * max(1, docs.count())
    left = as_rows(golay_simhash.keep_one(odd))
    assert left[3] == 1 and left[106] == 0 and left[100] == 1 and left[101] == 0 and left[None] >= 1
    nameless = spark.createDataFrame([(None, "same text")] * 5 + [(None, None)] * 2 + [(8, "same text")] * 2, "doc_id long, text string")
    assert as_rows(golay_simhash.keep_one(nameless)) == {None: 7, 8: 1}
    clean = as_rows(fm_decontam.drop_contaminated(odd, benchmark))
    assert clean[3] == 0 and clean[106] == 0 and clean[105] == 0 and clean[104] == 1 and clean[5] == 1 and clean[100] == 1


# ---------------------------------------------------------------- 1


def test_ordinal_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 4)), rng.permutation(6)[:3], rng.normal(size=3)) for _ in range(20)]
    x = rng.normal(size=3 + 6) * 0.3
    _, grad = ordinal_quality.loss_and_gradient(x, 4, rows)
    for k in range(len(x)):
        step = np.zeros_like(x)
        step[k] = 1e-6
        slope = (ordinal_quality.loss_and_gradient(x + step, 4, rows)[0] - ordinal_quality.loss_and_gradient(x - step, 4, rows)[0]) / 2e-6
        assert abs(slope - grad[k]) < 1e-4 * max(1, abs(slope))


def test_ordinal_grades_are_learnt(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["good"] * g + ["bad"] * (2 - g) + ["word", "text"], k=40)), g) for i in range(240) for g in [i % 3]]
    df = spark.createDataFrame(docs, "doc_id long, text string, grade int")
    model = ordinal_quality.fit(df, df.select("doc_id", "grade"), 3, dims=1 << 10, rounds=15)
    assert model.thresholds[0] < model.thresholds[1]
    rows = ordinal_quality.quality(df, model).join(df.select("doc_id", "grade"), "doc_id").collect()
    mean = {g: np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in range(3)}
    assert mean[0] + 0.4 < mean[1] < mean[2] - 0.4


def plain_features(text, dims):
    """Dense hashed features of a text, written from their description."""
    x, tokens = np.zeros(dims), text.split()
    lowered = Counter(tokens)
    length = np.sqrt(sum(np.log1p(n) ** 2 for n in lowered.values())) or 1.0
    for t, n in lowered.items():
        x[zlib.crc32(t.lower().encode()) % dims] += np.log1p(n) / length
        shape = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", t)))
        x[zlib.crc32((shape[:1] + shape[-3:]).encode(), 77) % dims] += 2 * n / len(tokens)
    repeated = 1 - len(lowered) / len(tokens) if tokens else 1.0
    x[zlib.crc32(f"repeats {int(repeated * 10)}".encode()) % dims] += 1
    x[zlib.crc32(f"size {int(np.log1p(len(tokens)))}".encode()) % dims] += 1
    return x


def plain_ordinal(x, grade, k, ridge, steps=20_000):
    """Cumulative-link regression by plain gradient descent on (weights, thresholds)."""
    w, cuts = np.zeros(x.shape[1]), np.linspace(-1, 1, k - 1)
    sig = lambda z: 1 / (1 + np.exp(-z))
    rate = 0.004

    def loss(w, cuts):
        below = np.column_stack([np.zeros(len(x)), sig(cuts[None, :] - (x @ w)[:, None]), np.ones(len(x))])
        return -np.log(below[np.arange(len(x)), grade + 1] - below[np.arange(len(x)), grade]).sum() + ridge * w @ w

    for _ in range(steps):
        below = np.column_stack([np.zeros(len(x)), sig(cuts[None, :] - (x @ w)[:, None]), np.ones(len(x))])
        up, low = below[np.arange(len(x)), grade + 1], below[np.arange(len(x)), grade]
        p, du, dl = up - low, up * (1 - up), low * (1 - low)
        gw = x.T @ ((du - dl) / p) + 2 * ridge * w
        gc = np.array([(-du[grade == c] / p[grade == c]).sum() + (dl[grade == c + 1] / p[grade == c + 1]).sum() for c in range(k - 1)])
        w, cuts = w - rate * gw, cuts - rate * gc
    return w, cuts, loss(w, cuts)


def test_ordinal_fit_equals_a_plain_refit_and_grades_other_documents(spark):
    rng = random.Random(21)
    word = lambda g: rng.choice(["good", "fine", "Great"] if rng.random() < 0.2 + 0.3 * g else ["bad", "poor", "x1"])
    rows = [(i, " ".join(word(i % 3) for _ in range(rng.randint(5, 30))), i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int").repartition(2)
    seen = df.filter("doc_id < 150")
    model = ordinal_quality.fit(seen, seen.select("doc_id", "grade"), 3, dims=32, ridge=0.5, rounds=40)
    x, grade = np.array([plain_features(t, 32) for _, t, _ in rows]), np.array([g for _, _, g in rows])
    w, cuts, best = plain_ordinal(x[:150], grade[:150], 3, 0.5)
    packed = np.concatenate((model.thresholds[:1], np.log(np.diff(model.thresholds)), model.weights))
    mine, _ = ordinal_quality.loss_and_gradient(packed, 3, [(int(g), np.arange(32), v) for g, v in zip(grade[:150], x[:150], strict=True)])
    assert best - 1e-6 <= mine + 0.5 * model.weights @ model.weights < best * 1.003
    # a shift of all scores moves the thresholds with it, so what is compared is what is returned
    got = {r["doc_id"]: r for r in ordinal_quality.quality(df, model, keep_from=2).collect()}
    for (i, _, _), score, own in zip(rows, x @ w, x @ model.weights, strict=True):
        below = 1 / (1 + np.exp(-(cuts - score)))
        exact = 1 / (1 + np.exp(-(model.thresholds - own)))
        assert abs(got[i]["expected_grade"] - (2 - exact.sum())) < 1e-9 and abs(got[i]["tail_probability"] - (1 - exact[1])) < 1e-9
        assert abs(got[i]["expected_grade"] - (2 - below.sum())) < 0.08 and abs(got[i]["tail_probability"] - (1 - below[1])) < 0.06
    mean = [np.mean([got[i]["expected_grade"] for i in range(150, 240) if i % 3 == g]) for g in range(3)]
    assert mean[0] + 0.3 < mean[1] < mean[2] - 0.3


# ---------------------------------------------------------------- 2


def test_url_filter_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.x.org", "x.org", "b.x.org", "y.net", "deep.a.x.org"]
    entries = [(rng.choice(hosts), rng.randint(0, 400_000), rng.choice(["block", "allow"])) for _ in range(60)] + [(None, 5, "block"), ("y.net", None, "block"), ("y.net", 7, None)]
    captures = [(i % 90, rng.choice([f"https://u@{h}:80/p", f"http://{h.upper()}?q", "nonsense", None]) if (h := rng.choice(hosts)) else None, rng.randint(0, 450_000) if rng.random() > 0.1 else None) for i in range(100)]
    e = spark.createDataFrame(entries, "host string, t long, action string").select("host", F.timestamp_seconds("t").alias("effective_at"), "action")
    c = spark.createDataFrame(captures, "page_id long, url string, t long").select("page_id", "url", F.timestamp_seconds("t").alias("fetched_at"))
    got = Counter((r["page_id"], r["matched_host"], r["action"], r["blocked"]) for r in url_asof.filter_captures(c, e).collect())
    want = Counter()
    for page, url, t in captures:
        m = re.match(r"^[a-z]+://(?:[^/@?#]*@)?([^/:?#]+)", url or "", re.I)
        host, hit = (m[1].lower() if m else None), None
        if host and t is not None:
            labels = host.split(".")
            for i in range(max(1, len(labels) - 1)):
                name = ".".join(labels[i:])
                past = [(at, action) for h, at, action in entries if h == name and at is not None and action and at <= t]
                if past:
                    hit = (name, max(past)[1])
                    break
        want[(page, *(hit or (None, None)), bool(hit and hit[1] == "block"))] += 1
    assert got == want
    spans = url_asof.intervals(e).collect()
    assert all(r["valid_to"] is None or r["valid_from"] < r["valid_to"] for r in spans)


def test_url_filter_without_entries(spark):
    e = spark.createDataFrame([], "host string, effective_at timestamp, action string")
    c = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string").withColumn("fetched_at", F.current_timestamp())
    row = url_asof.filter_captures(c, e).first()
    assert row["host"] == "x.org" and row["blocked"] is False and row["action"] is None


# ---------------------------------------------------------------- 3


def test_toxicity_learns_rare_words_by_stem(spark):
    rng = random.Random(4)
    common = [f"{rng.choice('abcdefgh')}{i:x}word" for i in range(300)]
    docs = []
    for i in range(1200):
        toxic = i % 6 == 0
        words = rng.choices(common, k=60)
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["vileness", "scorned"]) if rng.random() < 0.5 else "spite" + "".join(rng.choices("abcdefgh", k=3)))
        docs.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    rows = toxicity_kn.toxicity(df, toxicity_kn.fit(df, df.select("doc_id", "toxic"))).join(df.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97


def plain_spelling(words, letter):
    """The character model of words with repeats, from its definition: P of a word."""
    order, discount, n = toxicity_kn.ORDER, toxicity_kn.DISCOUNT, Counter()
    for w in words:
        s = f"\x01{w}\x02"
        n.update((s[max(0, i - k + 1) : i], s[i]) for i in range(1, len(s)) for k in range(1, min(order, i + 1) + 1))

    def probability(h, x):
        under = {c: m for (g, c), m in n.items() if g == h}
        kept = {c: max(m - discount, 0) / sum(under.values()) for c, m in under.items()}
        return kept.get(x, 0) + (1 - sum(kept.values())) * (probability(h[1:], x) if h else letter(x))

    def word(w):
        s = f"\x01{w}\x02"
        return np.prod([probability(s[max(0, i - order + 1) : i], s[i]) for i in range(1, len(s))])

    return word, probability


def test_toxicity_is_kneser_ney_of_words_and_their_spelling(spark):
    rng = random.Random(12)
    vocab = [a + b for a in ("ab", "ba", "longer", "\u00e9") for b in ("", "a", "bx", "tail")]
    texts = [([rng.choice(vocab) for _ in range(rng.randint(0, 9))], i % 3 // 2, i % 4) for i in range(60)]
    train = spark.createDataFrame([(" ".join(w), y, f) for w, y, f in texts], "text string, label int, fold int").repartition(3)
    counts = toxicity_kn.count(train, train)
    asked = [*vocab, "new", "longerab"]
    for without in (None, 0, 3):
        model = toxicity_kn.NgramModel(counts, without)
        letter = lambda x: dict(zip(model.letter_keys.tolist(), model.letters.tolist())).get(ord(x), model.letters.min() / 2)
        own, spelled = [], model.spelled(asked)
        for label in (0, 1):
            seen = [w for words, y, f in texts if y == label and f != without for w in set(words)]
            plain, probability = plain_spelling(seen, letter)
            assert np.allclose(spelled[:, label], [plain(w) for w in asked])
            assert abs(sum(probability("\x01longe"[-(toxicity_kn.ORDER - 1) :], chr(int(c))) for c in model.letter_keys) - 1) < 1e-9
            kept = {w: m - 1 for w, m in Counter(seen).items() if m >= 3}
            back = 1 - sum(kept.values()) / len(seen)
            shared = [(sum(w in words for words, _, _ in texts) + 0.5) / sum(len(set(words)) for words, _, _ in texts) if w in counts.words else counts.rare for w in asked]
            own.append([kept.get(w, 0) / len(seen) + back * (q + s) / 2 for w, q, s in zip(asked, shared, spelled[:, label])])
        assert np.allclose(model.log_ratios(asked), np.log1p(toxicity_kn.SHARE * (np.array(own[1]) / own[0] - 1)))


def test_toxicity_score_rises_with_the_mean_log_ratio_of_the_whole_text(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["plain", "usual", "words", "here"], k=40) + ["awful"] * (i % 4 == 0))) for i in range(300)], "doc_id long, text string")
    model = toxicity_kn.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert model.weights[0] > 0
    texts = pa.array(["", "plain usual", "awful", "awful " + "plain " * 30, "plain " * 30 + "awful", "awful " + "plain " * 3000, None])
    mean, n = model.means(texts)
    score, _ = model.scores(texts)
    assert (np.argsort(mean, kind="stable") == np.argsort(score, kind="stable")).all() and list(n) == [0, 2, 1, 31, 31, 3001, 0]
    assert score[3] == pytest.approx(score[4]) and score[2] > score[3] > score[5] and score[0] == score[6]


def test_toxicity_without_two_classes(spark, none):
    docs = spark.createDataFrame([(i, "some words") for i in range(9)], "doc_id long, text string")
    for labels in (docs.select("doc_id", F.lit(1).alias("toxic")), docs.limit(0).select("doc_id", F.lit(1).alias("toxic"))):
        rows = toxicity_kn.toxicity(docs, toxicity_kn.fit(docs, labels)).collect()
        assert {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {0}


# ---------------------------------------------------------------- 4


def test_license_forms(spark):
    mit = "MIT License\n\n" + license_digest.LICENSES["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, mit.replace(",", " ;").replace("Software", "  SOFTWARE")), (3, mit + " more"), (4, "text\nReleased under the M.I.T. Licence\nend"), (5, "a\nLicenced under CC BY-NC 4.0!\nLicensed under CC-BY-NC-4.0\nReleased under the MIT License."), (6, None)]
    got = {r["doc_id"]: r for r in license_digest.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[5]["line_licenses"] == "CC-BY-NC-4.0,MIT" and got[5]["n_license_lines"] == 3 and got[6]["n_license_lines"] == 0
    assert got[6]["text_digest"] == hashlib.sha256(b"").hexdigest()


def test_every_known_license_is_found_whole(spark):
    """Each licence under each heading, with a copyright line, in capitals and in other spellings."""
    forms = [lambda t: t, str.upper, lambda t: "(c) 1999 A. Holder\n" + t, lambda t: re.sub(r"\b(sub)?license\b", r"\1licence", t).replace("copyright holder", "copyright owner"), lambda t: t.replace("\n", "\n\n * ")]
    rows = [(i, f(t), name) for i, ((name, t), f) in enumerate((x, f) for x in license_digest.known_texts() for f in forms)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = {r["doc_id"]: r["license_id"] for r in license_digest.license_scan(df).collect()}
    assert all(got[i] == name for i, _, name in rows)
    own = spark.createDataFrame([("X-1", "Only\nthese words."), (None, "a"), ("X-2", None), ("X-0", "only THESE words")], "license_id string, text string")
    df = spark.createDataFrame([(1, "Only these, words!"), (2, "only these"), (3, "relicences onlythese words")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in license_digest.license_scan(df, own).collect()} == {1: "X-0", 2: None, 3: None}
    assert license_digest.normalise("Licence licence relicence per cent") == "license license relicence percent"


# ---------------------------------------------------------------- 5


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x" * 20) + chunk(b"IEND", b"")


def test_media_round_trip_and_carving():
    finder = media_sniff.automaton()
    seen = set()
    for text in ["", "a", "b" * 192, "c" * 193, "RIFF BM P5\n GIF89a", "é" * 500, "z" * 10_000]:
        payload, n = media_sniff.padded(text)
        stored = media_sniff.store(payload)
        files = media_sniff.carve(stored, finder)
        assert files[0][:2] == (0, len(stored)) and media_sniff.samples(stored, *files[0])[0] == payload and n == len(text.encode())
        seen.add(files[0][2])
        inner = media_sniff.carve(b"BMRIFF" + stored + b"junk" + png() + b"GIF89a", finder)
        assert (6, len(stored), files[0][2]) in inner and (10 + len(stored), len(png()), "image/png") in inner
        assert not media_sniff.carve(stored[:-1], finder)
    assert len(seen) > 1
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02" + b"\x02ab\x00" + b"\x3b"
    assert media_sniff.carve(b"--" + gif + b"--", finder) == [(2, len(gif), "image/gif")]
    broken = bytearray(png())
    broken[40] ^= 1
    assert not media_sniff.carve(bytes(broken), finder)


def test_sniffing_files_of_all_kinds(spark):
    """Valid foreign files, headers with comments, cut files and empty values at offset 0."""
    gif = b"GIF89a" + bytes([3, 0, 2, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02" + b"\x02ab\x00" + b"\x3b"
    payload = bytes(range(192))
    wav = struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 228, b"WAVEfmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", 192) + payload
    pgm = b"P5 # a long comment " + b"x" * 60 + b"\n16\t12\n# more\n255\n" + payload
    files = [gif, png(), wav, pgm, wav[:-1], None, b"", b"P5 0 0 255 ", b"GIF89a", pgm + gif]
    rows = spark.createDataFrame([(i, 0, f, "image/gif") for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary, declared_type string")
    got = {r["doc_id"]: r for r in media_sniff.sniff(rows).collect()}
    assert [got[i]["media_type"] for i in range(10)] == ["image/gif", "image/png", "audio/wav", "image/x-portable-graymap", None, None, None, None, None, "image/x-portable-graymap"]
    assert got[0]["feature"] == "image/gif;size=3x2" and got[0]["payload_bytes"] == 0 and got[1]["feature"] == "image/png;size=0x0"
    for i in (2, 3, 9):
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(payload[-16:])
    assert got[3]["feature"].startswith("image/x-portable-graymap;size=16x12;mean=95.5") and got[9]["n_embedded"] == 1
    assert not got[0]["corrected"] and got[1]["corrected"] and not got[4]["corrected"]


def test_carved_files(spark):
    rows = [(1, b"head" + png() + b"tail"), (2, None), (3, b"")]
    got = media_sniff.carve_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert [(r["doc_id"], r["at"], bytes(r["file"])) for r in got] == [(1, 4, png())]


# ---------------------------------------------------------------- 6


def test_mix_keeps_totals_in_many_levels(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 40), None if i % 50 == 0 else f"s{i % 3 if i % 2 else 0}") for i in range(3000)], "doc_id long, text string, source string")
    rows = pivotal_mix.mix(docs, weights=(1.0, 1.7, 0.4), fan_in=8)
    got = rows.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m"), F.first("source_size").alias("s"), F.max("copies").alias("c"), F.min("copies").alias("least")).collect()
    assert len(got) == 4 and abs(sum(r["t"] for r in got) - sum(r["s"] for r in got)) < 1e-6
    for r in got:
        assert abs(r["k"] - r["t"]) <= 3 * r["m"] and r["c"] - r["least"] <= 1
    assert rows.count() == 3000


def test_mix_comes_near_targets_with_outliers_and_repeated_rows(spark):
    """One document holds a tenth of its source; thousands of rows share a null id and a text."""
    rng = random.Random(13)
    rows = [(i, "w " * (400 if i % 100 == 0 else rng.randint(20, 60)), f"s{i % 4}") for i in range(2000)] + [(None, "same text here", "s9")] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = pivotal_mix.copies(docs, fan_in=64)
    assert got.count() == 7000
    for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("k")).collect():
        assert abs(r["k"] - r["t"]) < 0.005 * r["t"], r
    mixed = {(r["doc_id"], r["source"]): r["n"] for r in pivotal_mix.mixed_documents(docs, fan_in=64).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {(r["doc_id"], r["source"]): r["n"] for r in got.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()}
    assert mixed == {k: v for k, v in want.items() if v}


def test_mix_keeps_chances(spark):
    """Over many seeds each document is taken about as often as its fraction says."""
    docs = spark.createDataFrame([(i, "w " * (200 if i == 0 else 10 + i % 7), "a" if i < 40 else "b") for i in range(80)], "doc_id long, text string, source string")
    runs = [pivotal_mix.copies(docs, weights=(1.0, 1.5), seed=s).select("doc_id", "copies", (F.col("target") / F.col("source_size")).alias("share")) for s in range(12)]
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    got = rows.groupBy("doc_id").agg(F.avg("copies").alias("m"), F.first("share").alias("share")).collect()
    assert np.mean([abs(r["m"] - r["share"]) for r in got]) < 0.2 and abs(np.mean([r["m"] - r["share"] for r in got])) < 0.05


def test_mixed_documents_repeat_rows(spark, odd):
    copies = {r["doc_id"]: r["c"] for r in pivotal_mix.mix(odd).groupBy("doc_id").agg(F.sum("copies").alias("c")).collect()}
    assert as_rows(pivotal_mix.mixed_documents(odd)) == Counter({k: v for k, v in copies.items() if v})


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("block_windows", [3, 1000])
def test_contamination_against_brute_force(spark, block_windows):
    rng = random.Random(8)
    vocab = ["Ab", "b", "C!", "é", "d9"]
    docs = [(i, " ".join(rng.choices(vocab + ["zz"], k=rng.choice([0, 3, 30, 200])))) for i in range(40)] + [(90, None)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 4, 7])))) for i in range(12)] + [(50, None)]
    items += [(60, " ".join(docs[5][1].split()[3:9]))]
    got = fm_decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"), width=4, shard_words=150, block_windows=block_windows)
    for r in got.collect():
        words, hit, names = brute_windows(dict(docs)[r["doc_id"]], items, 4)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), sum(hit), len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        spans = [0] * len(words)
        for s in r["spans"]:
            for k in range(s["first"], s["last"]):
                spans[k] = 1
        assert spans == hit


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(9)
    text = rng.integers(1, 4, 300)
    text[rng.integers(0, 299, 20)] = 0
    text[-1] = 0
    text[100:140] = text[40:80]
    index = fm_decontam.FMIndex(text, 3)
    order = index.locate(np.arange(300))
    assert sorted(order) == list(range(300))
    for size in (1, 2, 5):
        for at in range(0, 290, 7):
            p = text[at : at + size]
            if (p == 0).any():
                continue
            low, high = index.search(p[None, :])
            found = sorted(index.locate(np.arange(low[0], high[0])))
            assert found == [i for i in range(300 - size + 1) if (text[i : i + size] == p).all()]


# ---------------------------------------------------------------- 8


def test_golay_code():
    words = np.arange(1 << 23)
    assert (np.bincount(golay_simhash.golay_index(words)) == 2048).all()
    rng = np.random.default_rng(10)
    some = rng.integers(0, 1 << 23, 2000)
    base = golay_simhash.golay_index(some)
    codes = {}
    for w, c in zip(words[:: 1 << 11], golay_simhash.golay_index(words[:: 1 << 11]), strict=True):
        codes.setdefault(int(c), int(w))
    assert base.max() < 4096


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * 2 + rng.integers(0, 2, 40, dtype=np.uint64)
    fps = set(map(int, base))
    for b in map(int, base):
        for k in (1, 2, 3, 4):
            for _ in range(6):
                fps.add(b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = golay_simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).distinct().collect()
    pairs = {(r["a"], r["b"]) for r in got}
    mask = (1 << 64) - 1
    assert pairs == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    with pytest.raises(ValueError):
        golay_simhash.fingerprint_links(spark.createDataFrame([], "fp long"), 4)


# ---------------------------------------------------------------- 9

KEY = "rotate0this0key"
SAMPLES = {
    "card": ["4315726095712222", "4735 3200 8523 7796", "4735-3200-8523-7796"],
    "phone": ["+1 (342) 555-8390", "+1(342)555-8390", "+1 (036) 155-8390"],
    "ipv4": ["57.14.248.132", "0.0.0.0", "255.255.255.255"],
    "date": ["2024-02-29", "1800-01-01", "2199-12-31"],
    "email": ["anna.B.7@mail.example.com", "x@y.org", "..-ann.b@y.org", "n" * 80 + ".m@y.org"],
    "secret": ["password=e3b3ed3cc8548923d6"],
}
INVALID = ["4315726095712223", "300.1.1.1", "2023-02-29", "1.2.3", "12345", "01.2.3.4"]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_format_and_agree_with_python(spark):
    values = [(k, v) for k, vs in SAMPLES.items() for v in vs]
    rows = spark.createDataFrame(values, "kind string, v string").select("kind", "v", feistel_pii.pseudonym("v", KEY).alias("p")).collect()
    for r in rows:
        assert r["p"] == feistel(r["kind"], r["v"], KEY), r
        if r["kind"] != "email" or len(r["v"]) > 8:
            assert r["p"] != r["v"] or r["kind"] == "ipv4"
        assert re.sub("[0-9]", "0", r["p"]) == re.sub("[0-9]", "0", r["v"]) or r["kind"] in ("ipv4", "email", "secret")
        if r["kind"] == "card":
            assert luhn(re.sub(r"\D", "", r["p"]))
    same = spark.createDataFrame([(v,) for v in INVALID], "v string").select("v", feistel_pii.pseudonym("v", KEY).alias("p")).collect()
    assert all(r["v"] == r["p"] for r in same)


def test_phones_stay_valid_and_keys_out_of_plans(spark):
    phones = spark.range(3000).select(F.concat(F.lit("+1 ("), (F.col("id") % 800 + 200).cast("string"), F.lit(") "), (F.col("id") * 7 % 800 + 200).cast("string"), F.lit("-0123")).alias("v"))
    out = phones.select("v", feistel_pii.pseudonym("v", KEY).alias("p"))
    assert out.filter(F.col("p").rlike(r"^\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}$")).count() == 3000
    assert out.select("p").distinct().count() == phones.distinct().count()
    plan = feistel_pii.pseudonymise(phones.select(F.lit(1).alias("doc_id"), F.col("v").alias("text")), KEY)._jdf.queryExecution().toString()
    assert KEY not in plan and "redacted" in plan


def test_feistel_is_a_bijection(spark):
    days = spark.range(0, 3000).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("v"))
    assert days.select(feistel_pii.pseudonym("v", KEY).alias("p")).distinct().count() == 3000
    small = spark.range(0, 1000).select(F.concat(F.lit("10.0.0."), (F.col("id") % 256).cast("string")).alias("v")).distinct()
    assert small.select(feistel_pii.pseudonym("v", KEY).alias("p")).distinct().count() == 256


def test_texts_change_in_matches_only(spark):
    text = "Call +1 (342) 555-8390 4315726095712222, from 57.14.248.132 on 2024-02-29; not 300.1.1.1.\nanna.B.7@mail.example.com password=e3b3ed3cc8548923d6 4315726095712223"
    rows = [(1, text), (2, text + "x"), (3, None), (4, ""), (5, "nothing"), (6, "4315726095712222")]
    got = {r["doc_id"]: r for r in feistel_pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert got[1]["n_replaced"] == 6 and got[1]["kinds"] == "card,date,email,ipv4,phone,secret"
    for v in ("555-8390", "4315726095712222", "57.14.248.132", "2024-02-29", "anna.B.7", "e3b3ed3cc8548923d6"):
        assert v not in got[1]["text"]
    assert "not 300.1.1.1.\n" in got[1]["text"] and got[1]["text"].endswith(" 4315726095712223") and got[1]["text"].startswith("Call +1 (")
    assert got[2]["text"][:-1] == got[1]["text"] and got[6]["text"] in got[1]["text"]
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "nothing" and got[5]["n_replaced"] == 0


# ---------------------------------------------------------------- 10


def test_cards_within_longer_runs_and_long_secrets_change(spark):
    card, other = "4735 3200 8523 7796", "4315 7260 9571 2222"
    new = {x: feistel("card", x, KEY) for x in (card, other)}
    around = ["{} 123", "{} 12 items", "12 {}", "{} 12/27", "1234 {}", "{} 1234 5678", "12 {}, 300.1.1.1"]
    rows = list(enumerate(x.format(card) for x in around))
    rows += [(20, f"{card} {other} 7"), (21, f"{card} 2024-02-29"), (22, f"{card} 57.14.248.132"), (23, "secret=" + "0a" * 80), (24, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 x".replace("1", "11111111111111111111"))]
    got = {r["doc_id"]: r for r in feistel_pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for i, x in enumerate(around):
        assert got[i]["text"] == x.format(new[card]) and got[i]["n_replaced"] == 1, x
    assert got[20]["text"] == f"{new[card]} {new[other]} 7" and got[20]["n_replaced"] == 2
    assert got[21]["text"] == f"{new[card]} {feistel('date', '2024-02-29', KEY)}" and got[21]["kinds"] == "card,date"
    assert got[22]["text"] == f"{new[card]} {feistel('ipv4', '57.14.248.132', KEY)}" and got[22]["kinds"] == "card,ipv4"
    assert got[23]["text"] == feistel("secret", "secret=" + "0a" * 80, KEY) != "secret=" + "0a" * 80
    assert got[24]["text"] == rows[-1][1]


def test_repeated_rows_spread_over_shards(spark):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(2000)] + [(None, "y" * 200)] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    load, slots = Counter(), defaultdict(list)
    for r in slot_sharding.shard_documents(docs).collect():
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(load.values()) / 8
    assert len(load) == 8 and max(load.values()) < 1.1 * mean and min(load.values()) > 0.9 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 4000


def test_slot_map_grows_into_new_shards_only(spark):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 900)) for i in range(3000)], "doc_id long, text string")
    rows = slot_sharding.records(docs, 256)
    first = slot_sharding.first_map(slot_sharding.slot_loads(rows, 256), 8)
    second = slot_sharding.grown_map(first, 2)
    a, b = ({r["virtual_slot"]: r for r in m.collect()} for m in (first, second))
    assert len(a) == len(b) == 256 and {r["version"] for r in b.values()} == {2}
    assert all(b[s]["shard"] == a[s]["shard"] or b[s]["shard"] in (8, 9) for s in a)
    load = defaultdict(int)
    for r in b.values():
        load[r["shard"]] += r["bytes"]
    mean = sum(load.values()) / 10
    assert len(load) == 10 and max(load.values()) < 1.25 * mean and min(load.values()) > 0.75 * mean
    placed = slot_sharding.place(rows, second).collect()
    by = defaultdict(list)
    for r in placed:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(placed) == 3000


def chunks(*parts):
    return b"".join(struct.pack("<4sI", kind, len(data)) + data + b"\0" * (len(data) % 2) for kind, data in parts)


def wav(bits, data, extra=()):
    body = b"WAVE" + chunks((b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 8000 * 2 * bits // 8, 2 * bits // 8, bits)), *extra, (b"data", data), (b"id3 ", b"odd"))
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def bmp(width, rows, depth, top_down=False, head=40):
    stride = (width * depth + 31) // 32 * 4
    lines = [r.ljust(stride, b"\xee") for r in (rows if top_down else rows[::-1])]
    offset = 14 + head + (1024 if depth == 8 else 0)
    body = struct.pack("<IIIiiHHI", 0, offset, head, width, len(rows) * (-1 if top_down else 1), 1, depth, 0).ljust(head + 8, b"\0") + bytes(offset - 14 - head) + b"".join(lines)
    return b"BM" + struct.pack("<I", len(body) + 6) + body


def true_png(width, rows, colour, filters):
    channels, above, raw = {0: 1, 2: 3, 6: 4}[colour], bytes(len(rows[0])), b""
    for row, how in zip(rows, filters, strict=True):
        left = bytes(channels) + row[:-channels]
        corner = bytes(channels) + above[:-channels]
        paeth = [min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left, above, corner, strict=True)]
        guess = [bytes(len(row)), left, above, bytes((a + b) // 2 for a, b in zip(left, above, strict=True)), bytes(paeth)][how]
        raw += bytes([how]) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
        above = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0)) + chunk(b"IDAT", packed[:5]) + chunk(b"IDAT", packed[5:]) + chunk(b"IEND", b"")


def jpeg():
    segment = lambda mark, data: bytes([0xFF, mark]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xC0, b"\x08" + struct.pack(">HH", 7, 9) + b"\x01\x01\x11\0") + segment(0xDA, b"\x01\x01\0\0\x3f\0") + b"data\xff\0more\xff\xd0rest" + b"\xff\xd9"


def test_media_of_all_kinds_are_found_and_read():
    import io
    import zipfile

    rng = random.Random(19)
    some = lambda n: bytes(rng.randrange(256) for _ in range(n))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "text " * 50)
        z.writestr("b/c.bin", some(30))
        z.comment = b"comment"
    lines = [some(15) for _ in range(6)]
    files = [
        (wav(16, data := some(40)), "audio/wav", data), (wav(8, data8 := some(30), [(b"LIST", b"INFOx")]), "audio/wav", data8), (wav(24, data24 := some(60)), "audio/wav", data24),
        (bmp(5, lines[:2], 24), "image/bmp", b"".join(lines[:2])), (bmp(5, lines, 24, True, 124), "image/bmp", b"".join(lines)), (bmp(15, lines, 8), "image/bmp", b"".join(lines)), (bmp(3, [x[:12] for x in lines], 32), "image/bmp", b"".join(x[:12] for x in lines)),
        (true_png(5, lines, 2, [0, 1, 2, 3, 4, 4]), "image/png", b"".join(lines)), (true_png(15, lines, 0, [4, 3, 2, 1, 0, 3]), "image/png", b"".join(lines)),
        (b"P6 # c\n5 1\r255 " + lines[0], "image/x-portable-pixmap", lines[0]), (b"P5\n#x\n#y\n5\t3\n9\n" + lines[1], "image/x-portable-graymap", lines[1]),
        (jpeg(), "image/jpeg", b""), (held.getvalue(), "application/zip", b""),
    ]
    finder, whole, places = media_sniff.automaton(), b"", []
    for file, kind, read in files:
        assert (0, len(file), kind) in media_sniff.carve(file, finder), kind
        assert media_sniff.samples(file, 0, len(file), kind)[0] == read, kind
        assert all(f[:2] != (0, len(file)) for f in media_sniff.carve(file[:-1], finder))
        whole += b"junk RIFF BM P5 \xff\xd8\xff GIF89a PK\x05\x06"
        places.append((len(whole), len(file), kind))
        whole += file
    found = media_sniff.carve(whole, finder)
    assert set(places) <= set(found)
    for (at, n, kind), (_, _, read) in zip(places, files, strict=True):
        assert media_sniff.samples(whole, at, n, kind)[0] == read


def test_hostile_bytes_are_validated_in_linear_time():
    import time

    finder = media_sniff.automaton()
    for hostile in (b"GIF89a" + bytes(8) + b"!\xff\x01", b"P5#", b"P5 #\x0b", b"BM", b"RIFF\xff\xff\x00\x00WAVE", b"\xff\xd8\xff\xe0\x00\x03", b"PK\x05\x06", b"\x89PNG\r\n\x1a\n"):
        began = time.time()
        assert media_sniff.carve(hostile * (1_000_000 // len(hostile)), finder) is not None
        assert time.time() - began < 20, hostile


def test_pseudonyms_of_very_long_runs(spark):
    """Long runs of digits, digit groups and labels, which a recursive pattern does not survive."""
    rng = random.Random(16)
    card = "4735 3200 8523 7796"
    groups = " ".join(rng.choice("0123456789") for _ in range(4000))
    rows = [(1, "7" * 200_000), (2, groups), (3, "a@" + ".".join(["b"] * 100_000)), (4, "1-" * 4000), (5, f"12 {card} " + " ".join(f"{rng.randrange(1000):03d}" for _ in range(3000))), (6, "password=" + "a" * 100), (7, "x" * 300_000)]
    got = {r["doc_id"]: r for r in feistel_pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert all(len(got[i]["text"]) == len(t) for i, t in rows)
    assert got[1]["n_replaced"] == 0 and got[1]["text"] == rows[0][1] and got[4]["text"] == rows[3][1] and got[7]["n_replaced"] == 0
    assert got[3]["kinds"] == "email" and got[6]["kinds"] == "secret"
    for i in (2, 5):  # what is left holds no run of whole groups that is a valid card and was one before
        assert got[i]["kinds"] == "card" and got[i]["n_replaced"] > 10
        assert re.sub(r"\d", "0", got[i]["text"]) == re.sub(r"\d", "0", rows[i - 1][1])
    assert card not in got[5]["text"]
