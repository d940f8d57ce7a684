"""Operators 11 to 13 against brute force, on odd rows and on empty tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.llm import common, filter_audit, nra_search, slot_sharding, token_groups
from lociweave.llm.common import hash_words
from lociweave.llm.golay_simhash import _LOWER

# ---------------------------------------------------------------- 11


def shingles(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(rows, percent=90, width=3):
    """Per row (doc_id, size, smallest id reachable), by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


def copies(rng, n_families, members, words=60, edits=6):
    """Families of edited copies about the threshold, chains included, and texts with a common passage."""
    vocab = [f"w{i}" for i in range(500)]
    passage = rng.choices(vocab, k=25)
    rows = []
    for _ in range(n_families):
        text = rng.choices(vocab, k=rng.randint(4, words))
        for _ in range(members):
            new = list(text)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(new))
                new[at : at + 1] = rng.choice([[rng.choice(vocab)], [], [new[at], rng.choice(vocab)]])
                new = new or ["x"]
            if rng.random() < 0.3:
                text = new  # a chain
            rows.append((len(rows), " ".join(new)))
    rows += [(1000 + i, " ".join(rng.choices(vocab, k=20) + passage + rng.choices(vocab, k=20))) for i in range(20)]
    return rows


def joined(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return Counter(tuple(r) for r in token_groups.jaccard_components(df, **options).collect())


def test_jaccard_components_against_all_pairs(spark):
    rng = random.Random(11)
    rows = copies(rng, 12, 8) + [(None, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (5000, "A b  c\nd e f g h i j k l"), (5001, "one"), (5002, "ONE"), (5003, "one two"), (5004, ""), (5005, None), (5006, " \t "), (None, None), (7, rng.choice("xyz"))]
    rows += rows[:3]
    assert joined(spark, rows) == plain_components(rows)
    assert joined(spark, rows[:60], shingle=2, percent=80) == plain_components(rows[:60], 80, 2)


def test_groups_of_one_member_and_small_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(12)
    rows = copies(rng, 3, 25, words=160, edits=3)
    want = plain_components(rows)
    assert len({c for _, _, c in want}) < len(rows) - 20  # there are links
    for members, queries, words in ((1, 2, 50), (3, 1, 10_000)):
        monkeypatch.setattr(token_groups, "MEMBERS", members)
        monkeypatch.setattr(token_groups, "QUERIES", queries)
        monkeypatch.setattr(token_groups, "WORDS", words)
        monkeypatch.setattr(token_groups, "BROADCAST_ROWS", 0)
        assert joined(spark, rows) == want


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        b = np.concatenate((a[int(rng.integers(0, 1 + n // 6)) :], rng.integers(0, 1 << 64, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)))
        a, b = np.unique(a), np.unique(b)
        keys, counts = token_groups.part_keys(np.concatenate((a, b)), np.array([len(a), len(b)]), percent)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            assert set(keys[: counts[0]].tolist()) & set(keys[counts[0] :].tolist())


def test_shingle_sets_of_many_texts_at_once():
    texts = ["a b c d", "", "x", "x y", "a b c a b c", "b c d", "  "]
    hashes, sizes = token_groups.shingle_sets([hash_words(t, _LOWER) for t in texts], 3)
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    parts = np.split(hashes, np.cumsum(sizes)[:-1])
    assert len(np.intersect1d(parts[0], parts[5])) == 1 and len(np.intersect1d(parts[0], parts[4])) == 1
    assert all((np.diff(p.astype(object)) > 0).all() for p in parts if len(p) > 1)


def test_jaccard_join_on_odd_rows_and_nothing(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in token_groups.jaccard_components(odd).collect())
    assert got == plain_components(rows)
    assert token_groups.jaccard_components(none).count() == 0
    with pytest.raises(ValueError, match="percent"):
        token_groups.jaccard_components(none, percent=100)


# ---------------------------------------------------------------- 12


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    words = [terms_of(t) for _, t in docs]
    n_docs, total = sum(1 for w in words if w), sum(map(len, words))
    counts = [Counter(w) for w in words]
    frequency = Counter(t for c in counts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for (doc, _), c, w in zip(docs, counts, words, strict=True):
            m = 10 + (90 * len(w) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


@pytest.mark.parametrize(("depth", "block"), [(32, 4 << 20), (1, 40)])
def test_search_against_brute_force(spark, monkeypatch, depth, block):
    rng = random.Random(13)
    vocab = [f"t{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(200 + i, docs[i % 4][1]) for i in range(30)] + [(None, docs[0][1]), docs[1], docs[1], (900, None), (901, ""), (902, "Ünïcode-T1 漢字_t2"), (903, "t5 " * 20_000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 12)))) for i in range(12)] + [(3, "t1 t1 T2"), (None, "t3"), (50, None), (51, ""), (52, "unknown words"), (53, "漢字 t2 ünïcode")]
    monkeypatch.setattr(nra_search, "FIRST_DEPTH", depth)
    monkeypatch.setattr(nra_search, "BLOCK_BYTES", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
        got = Counter(tuple(r) for r in nra_search.search(d, spark.createDataFrame(items, "item_id long, text string")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_search(docs, items)


def test_reads_stop_before_the_end_of_the_lists():
    """Intervals settle early where one document stands out: few postings are read."""
    n = 5000
    terms, counts = np.concatenate((np.zeros(n, np.int64), [1])), np.concatenate((np.ones(n, np.int64), [1]))
    lengths = np.array([1] * (n - 1) + [2])
    segment = nra_search.Segment(np.full(n, 10), lengths, np.concatenate((np.zeros(n, np.int64), [1])), counts, np.array([1, 9000]), n, 10 * n)
    assert terms.size == n + 1
    found, scores = segment.best(np.array([0, 1]), 1, 0)
    assert found.tolist() == [n - 1] and scores[0] == segment.impact[segment.first[0]] + segment.impact[segment.first[1]]
    assert len(segment.best(np.array([0]), 1, 10**12)[0]) == 0


def test_search_over_nothing(spark, none, odd):
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert nra_search.search(none, items).count() == 0
    assert nra_search.search(odd, items.limit(0)).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in nra_search.search(odd, items).collect()) == plain_search(rows, [(1, "w1 w2")])


# ---------------------------------------------------------------- 13


def plain_audit(docs, labels, filters="ABCDE"):
    """Rows of the audit by running the filters in every order."""
    good, toxic = ({d for d, *flags in labels if flags[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)

    def fails(d, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        return {f for f, failed in out.items() if failed}

    parts = defaultdict(list)
    for d, t, lang in docs:
        parts[lang or ""].append((d, fails(d, t)))
    out = {}
    for part, rows in parts.items():
        in_all = Counter()
        for order in itertools.permutations(filters):
            gone = set()
            for k, f in enumerate(order, 1):
                here = [i for i, (_, failed) in enumerate(rows) if f in failed and i not in gone]
                again = sum(f in failed and i in gone for i, (_, failed) in enumerate(rows))
                gone.update(here)
                in_all[f] += len(here)
                out[part, "".join(order), k] = [len(rows) - len(gone), len(here), again, sum(failed == {f} for _, failed in rows), sum(rows[i][0] in good for i in here), sum(rows[i][0] in toxic for i in here), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = in_all[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_against_every_order(spark, odd, none):
    rng = random.Random(14)
    pieces = ["word " * 250, " ".join(f"w{i}" for i in range(250)), "SHOUT " * 40, "50% & more ", " ".join(f"x{i % 90}" for i in range(210)), "", None]
    docs = [(rng.choice([i, i, None]), rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice(pieces[:5]) for _ in range(2)), rng.choice(["en", "de", "", None])) for i in range(120)]
    docs += docs[:5]
    labels = [(i, rng.choice([0, 1, None, 7]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(filter_audit.filter_audit(d, known)) == plain_audit(docs, labels)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.select("doc_id", "text", "lang").collect()]
    assert audited(filter_audit.filter_audit(odd, known.limit(0))) == plain_audit(rows, [])
    assert filter_audit.filter_audit(none, known).count() == 0


def test_swaps_visit_every_order_and_keep_every_count():
    rng = random.Random(15)
    for n in (1, 2, 3, 4):
        counts = {m: (rng.randint(0, 2), rng.randint(0, 1)) for m in range(1 << n) if rng.random() < 0.7} or {0: (1, 1)}
        diagram, seen = filter_audit.Diagram(counts, n), set()
        for place in [None, *filter_audit.swap_places(n)]:
            if place is not None:
                diagram.swap(place)
            seen.add(tuple(diagram.order))
            for mask in range(1 << n):
                node = diagram.root
                for f, level in zip(diagram.order, diagram.levels, strict=True):
                    node = level[node][mask >> f & 1]
                assert diagram.weight[node] == counts.get(mask, (0, 0))
            assert diagram.weight[diagram.root] == tuple(map(sum, zip(*counts.values(), strict=True)))
            # equal subdiagrams are one node
            assert all(len(set(level.values())) == len(level) for level in diagram.levels)
        assert len(seen) == math.factorial(n) == 1 + len(filter_audit.swap_places(n))


# ---------------------------------------------------------------- copies by number


def test_copies_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 7)
    rows = spark.createDataFrame([(1, 1), (2, 7), (3, 8), (4, 100)], "k long, n long")
    got = Counter(tuple(r) for r in common.each_copy(rows, "n", "copy").collect())
    assert got == Counter((k, n, i) for k, n in ((1, 1), (2, 7), (3, 8), (4, 100)) for i in range(n))


# ---------------------------------------------------------------- the stored slot map


def test_a_stored_slot_map_is_reused_and_edited(spark, tmp_path):
    rng = random.Random(18)
    docs = spark.createDataFrame([(i, "x" * rng.randint(0, 300)) for i in range(600)], "doc_id long, text string")
    path = f"{tmp_path}/map"
    run = lambda d, n: {(r["doc_id"], r["virtual_slot"]): (r["shard"], r["slot"], r["size"]) for r in slot_sharding.shard_documents(d, n, 64, map_path=path).collect()}
    first = run(docs, 3)
    assert run(docs, 3) == first  # the same map
    more = docs.unionByName(spark.createDataFrame([(1000 + i, "new") for i in range(50)], "doc_id long, text string"))
    second = run(more, 3)
    assert all(second[k][0] == v[0] for k, v in first.items()) and len(second) == 650
    third = run(more, 4)
    moved = {k for k in second if third[k][0] != second[k][0]}
    assert moved and all(third[k][0] == 3 for k in moved)
    sizes = Counter()
    for shard, _, size in third.values():
        sizes[shard] += size
    assert max(sizes.values()) < 1.5 * min(sizes.values())
    for shard in range(4):
        assert sorted(slot for s, slot, _ in third.values() if s == shard) == list(range(sum(s == shard for s, _, _ in third.values())))
    versions = spark.read.parquet(path)
    assert sorted(r["version"] for r in versions.select("version").distinct().collect()) == [1, 2] and versions.count() == 128
    with pytest.raises(ValueError, match="4 shards"):
        run(docs, 2)
