"""The pipeline's near copies against brute-force Jaccard similarities."""

import random
import re
from collections import defaultdict
from itertools import combinations

from lociweave.llm import shingle_jaccard


def brute_shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """The smallest id of each text's group, from all pairs that share a shingle."""
    sets, parent, holders, shared = {i: brute_shingles(t) for i, t in texts.items()}, {i: i for i in texts}, defaultdict(list), defaultdict(int)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for g in s or {None}:
            holders[g].append(i)
    for ids in holders.values():
        for pair in combinations(sorted(ids), 2):
            shared[pair] += 1
    for (a, b), n in shared.items():
        if not sets[a] and not sets[b] or n / len(sets[a] | sets[b]) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def edited(rng, n, texts=60):
    """Texts of n words, each followed by a few copies with some words changed or cut."""
    out = []
    for _ in range(texts):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        out.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, n // 35))):
                copy[rng.randrange(n)] = "edited"
            out.append("  ".join(copy[: n - rng.randint(0, n // 20)]).upper())
    return out


def groups(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["component_id"] for r in shingle_jaccard.near_copies(rows).collect()}


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(3)
    made = [*edited(rng, 60), *edited(rng, 200), *edited(rng, 9), None, "", " \n", "one two", "One\tTwo", "one three"]
    rng.shuffle(made)
    texts = dict(enumerate(made))
    assert groups(spark, texts) == brute_groups(texts)


def test_common_passage_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(70)]
    made = [" ".join([*passage, *[f"w{rng.randrange(5000)}" for _ in range(rng.choice((8, 14, 30)))]]) for _ in range(80)]
    made += [t.replace(" p40 ", " ") for t in made[:30]] + edited(rng, 60, 10)
    texts = dict(enumerate(made))
    want = brute_groups(texts)
    assert groups(spark, texts) == want
    monkeypatch.setattr(shingle_jaccard, "STARS", 1)
    assert groups(spark, texts) == want


def test_given_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_groups(texts)
    assert groups(spark, texts) == want
    left = shingle_jaccard.keep_one_copy(docs)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, c in want.items() if i == c)


def test_stage_drops_copies_beyond_three_bits(spark, sf_dir):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    changed = [*words[:30], "x", *words[31:70], "y", *words[71:]]
    rows = [(1, " ".join(words), "en", "a", 1), (2, " ".join(changed), "en", "a", 1), (3, " ".join(words[50:]), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [1, 3]


def test_keep_one_copy_takes_odd_rows(spark, odd, none):
    for docs in (odd, none):
        out = shingle_jaccard.keep_one_copy(docs)
        assert out.columns == docs.columns and out.count() <= docs.count()
    left = [r["doc_id"] for r in shingle_jaccard.keep_one_copy(odd).collect()]
    assert left.count(3) == 1 and 106 not in left and left.count(100) == 1 and 101 not in left and None in left


def test_stage_links_by_fingerprints_and_by_shingles(spark, sf_dir):
    """2 is within three bits of 1 and under 0.8 similar to it."""
    import corpus_pipeline
    from lociweave.llm.golay_simhash import simhash

    bits = lambda a, b: (simhash([w.encode() for w in a], 3) ^ simhash([w.encode() for w in b], 3)).bit_count()
    alike = lambda a, b: (lambda x, y: len(x & y) / len(x | y))(*[set(zip(*[t[i:] for i in range(5)], strict=False)) for t in (a, b)])
    common = [f"c{i % 3}" for i in range(300)]  # few distinct shingles, many repeats
    first, second = [*common, *[f"a{i}" for i in range(12)]], [*common, *[f"b{i}" for i in range(12)]]
    assert bits(first, second) <= 3 and alike(first, second) < 0.8
    rows = [(1, " ".join(first), "en", "a", 1), (2, " ".join(second), "en", "a", 1), (4, "another text of a few words", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [1, 4]
