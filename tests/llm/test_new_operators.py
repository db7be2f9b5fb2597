"""Spelling variants, SimHash groups and exact centroids against plain versions and SQL."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maskwell.llm import centroids, oracles, queries, simhash, spelling

FOLDER = "/root/testdata/sf0.001"
TABLES = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows(df):
    def plain(v):
        return "" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@TABLES
@pytest.mark.parametrize("name", ["op11_spelling", "op13_centroids"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.queries()[name](spark, FOLDER).toPandas()
    assert len(got)
    assert rows(got) == rows(con.sql(oracles.oracle_sql()[name]).df())


# --- spelling -----------------------------------------------------------------------------


def plain_vocabulary(texts, one_in=31):
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out[w] = (f, root, n, len(near[w]), words[f] if f else None)
    return out


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def random_words(seed, n):
    rng = np.random.default_rng(seed)
    letters = list("abeé÷ÿ")
    words = set()
    while len(words) < n:
        word = "".join(rng.choice(letters, rng.integers(1, 9)))
        words.add(word)
        for _ in range(3):
            at = rng.integers(0, len(word) + 1)
            words |= {word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]}
    return {w: int(10 ** rng.uniform(0, 4)) for w in words if w}


@pytest.mark.parametrize("group_words", [1024, 3])
def test_spelling_equals_plain_version(spark, group_words):
    words = random_words(4, 400)
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert spelled(spelling.variants(table, group_words=group_words)) == plain_variants(words)


def test_one_large_group_is_taken_apart(spark):
    """A thousand words that share their first letters and their last ones."""
    stem = "wordstart"
    rng = np.random.default_rng(1)
    words = {f"{stem}{''.join(rng.choice(list('abcde'), rng.integers(4, 7)))}ending": i + 1 for i in range(1000)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert spelled(spelling.variants(table, group_words=10)) == plain_variants(words)


def test_slices_track_both_sets():
    words = ["kitten", "sitten", "kittens", "kiten", "ktten", "kitte", "xkitten", "kittten", "mitton", "kitten"[::-1]]
    index = spelling.Slices(words)
    found = {words[i] for i in spelling._members(index.replaced("kitten", 0, 5))}
    assert found == {"sitten"}
    found = {words[i] for i in spelling._members(index.longer("kitten", 0, 6))}
    assert found == {"kittens", "xkitten", "kittten"}
    # The letter more of "kittten" can stand last at place 4, where the words first differ.
    assert {words[i] for i in spelling._members(index.longer("kitten", 4, 4))} == {"kittten"}


def test_spelling_odd_rows(spark, odd):
    more = odd.limit(1).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit("Variant VARIANT varyant varyant variannt variannt").alias("text")
    )
    both = odd.unionByName(more, allowMissingColumns=True)
    found = spelled(spelling.variants(spelling.vocabulary(both)))
    texts = [(r.doc_id, r.text) for r in both.collect()]
    assert found == plain_variants(plain_vocabulary(texts))
    assert found["variant"][2:4] == (2, 2)
    none = odd.filter("false")
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
    assert spelling.variants(spelling.vocabulary(odd.filter("text is null"))).count() == 0


def test_long_run_of_letters(spark):
    texts = [(i, "A" * 20_000 + " Å" * 3 + " WörtLICH wörtlicH") for i in range(3)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert spelled(spelling.variants(spelling.vocabulary(docs))) == plain_variants(plain_vocabulary(texts))


# --- SimHash ------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints, limit=3):
    """Label of each fingerprint: the smallest one reachable."""
    values = sorted(set(fingerprints))
    array = np.array(values, dtype=np.uint64)
    label = list(range(len(values)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(*np.nonzero(np.bitwise_count(array[:, None] ^ array[None, :]) <= limit)):
        a, b = root(x), root(y)
        label[max(a, b)] = min(a, b)
    return {v: values[root(i)] for i, v in enumerate(values)}


def test_fingerprint_against_plain_version(spark, odd):
    texts = [r.text for r in odd.collect()] + ["One TWO", "Ünï ÜNÏ\x0bx\x0cy", "\x1fa b\x85c d e"]
    for text in texts:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text)
    # Spark's own function is the same hash.
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == simhash._hash(b"a b c")


def families(seed, centres, members, flips):
    rng = np.random.default_rng(seed)
    out = {0, 3}
    for _ in range(centres):
        centre = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(members):
            x = centre
            for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    base = int(rng.integers(0, 1 << 63))
    out |= {base & ~0x3FFFFF | int(x) for x in rng.integers(0, 1 << 22, 800)}  # one hot value
    return sorted(out)


@pytest.mark.parametrize("parts, bucket_rows", [(4, 8192), (4, 40), (5, 200)])
def test_links_connect_what_all_pairs_connect(spark, parts, bucket_rows):
    values = families(parts, 20, 40, 4)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "node bigint")
    made = simhash.plan(nodes, parts)
    assert sorted(b for p in made.bits for b in p) == list(range(64))
    links = simhash.links(nodes, made, bucket_rows)
    found = simhash.components(links).collect()
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    want = plain_components(values)
    groups = defaultdict(set)
    for v in values:
        groups[root.get(v, v)].add(v)
    wanted = defaultdict(set)
    for v, r in want.items():
        wanted[r].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_links_grow_with_members_not_with_pairs(spark):
    """One family with all members near one another: links stay within a multiple of its size."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    family = sorted({base} | {base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)})
    signed = np.array(family, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "node bigint")
    links = simhash.links(nodes, simhash.plan(nodes), 100_000)
    assert links.count() < 4 * 8 * len(family)
    assert {r.root for r in simhash.components(links).collect()} == {min(signed)}


def test_thresholds_follow_the_counts(spark):
    """Values that share a hot partition leave that partition out."""
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 48, 4000).astype(np.uint64) << np.uint64(16))
    counts = [simhash.within(np.bincount(simhash.take(values, list(range(p, p + 16))), minlength=1 << 16), 16, 3) for p in (0, 16, 32, 48)]
    made = simhash.Plan([list(range(p, p + 16)) for p in (0, 16, 32, 48)], counts, 3)
    reach = made.thresholds(values)
    assert (reach.sum(axis=1) == 0).all()
    assert (reach[:, 0] == -1).all()


def test_counts_within_a_distance():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, 1 << 8)
    got = simhash.within(counts, 8, 3)
    every = np.arange(1 << 8)
    apart = np.bitwise_count(every[:, None] ^ every[None, :])
    for t in range(4):
        assert np.allclose(got[t], (counts[None, :] * (apart <= t)).sum(axis=1))


def test_simhash_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    texts = [(r.doc_id, plain_fingerprint(r.text)) for r in odd.collect()]
    root = plain_components([f for _, f in texts])
    low = defaultdict(list)
    for i, f in texts:
        if i is not None:
            low[root[f]].append(i)
    want = [(i, f"{f:016x}", min(low[root[f]], default=None)) for i, f in texts]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(odd.filter("false")).count() == 0
    assert simhash.near_duplicates(odd.filter("doc_id is null")).count() == 1


@TABLES
def test_simhash_on_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    root = plain_components(prints.values())
    low = {}
    for i, f in sorted(prints.items()):
        low.setdefault(root[f], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{f:016x}", low[root[f]]) for i, f in prints.items()}


# --- centroids ----------------------------------------------------------------------------


def plain_clusters(vectors, k, rounds, scale=1024):
    kept = [(i, np.floor(scale * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in vectors]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    kept.sort(key=lambda r: (name(r[0]), r[1].tolist()))
    x = np.array([v for _, v in kept])
    c = x[:k].copy()
    for _ in range(rounds):
        own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0) // (own == j).sum()
    d = ((x[:, None] - c[None]) ** 2).sum(-1)
    own, near = d.argmin(1), d.min(1)
    return sorted(
        (str(i), int(j), int(s), int(near[own == j].sum()), int(near.sum()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest())
        for (i, _), j, s in zip(kept, own, near)
    )


def clustered(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def blobs(seed, n, size, centres, width=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, size))
    x = middle[rng.integers(0, centres, n)] + width * rng.normal(size=(n, size))
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("width", [0.05, 3.0])
def test_centroids_equal_plain_version(spark, width):
    vectors = blobs(3, 1500, 64, 6, width)
    scanned = []
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    assert clustered(centroids.cluster(df, scanned=scanned)) == plain_clusters(vectors, 8, 10)
    if width < 1:  # in clustered data the bounds settle most vectors
        assert sum(scanned[1:]) < 0.3 * len(vectors) * 10


def test_ties_go_to_the_smaller_centroid(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.integers(0, 2, (400, 4)) / 1024)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = clustered(centroids.cluster(df, k=5, rounds=6, size=4))
    assert got == plain_clusters(vectors, 5, 6)


def test_bounds_hold_for_every_point_of_a_sphere():
    rng = np.random.default_rng(6)
    less = 0
    for _ in range(300):
        size = int(rng.integers(2, 6))
        centre, old, new = rng.normal(size=(3, size)) * rng.uniform(0.1, 3, (3, 1))
        radius = float(rng.uniform(0, 2))
        x = rng.normal(size=(400, size))
        x = centre + radius * x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0, 1, (400, 1)) ** 0.2
        gain = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
        bound = centroids.nearer_by(centre, radius, old, new)
        assert gain.max() <= bound + 1e-9
        less += bound < 0.9 * np.linalg.norm(new - old)
    assert less > 100


def test_centroids_odd_rows(spark):
    good = [(1, [0.5] * 64), (1, [0.5] * 64), (None, [1.0] * 64), (4, [-0.25] * 64)]
    bad = [(5, None), (6, []), (7, [1.0] * 63), (8, [None] + [1.0] * 63), (9, [float("nan")] * 64),
           (10, [float("inf")] + [0.0] * 63), (11, [1e30] * 64)]
    schema = "vec_id bigint, embedding array<double>"
    df = spark.createDataFrame(good + bad, schema).withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))
    assert clustered(centroids.cluster(df)) == plain_clusters(good, 8, 10)
    assert centroids.cluster(spark.createDataFrame(bad, schema)).count() == 0
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0


def test_blocks_are_not_shuffled_by_a_round(spark):
    df = spark.createDataFrame(blobs(1, 100, 64, 3), "vec_id bigint, embedding array<float>")
    tables = centroids._Tables(centroids.usable(df, "vec_id", "embedding", 64, 1024))
    first = centroids.first_centroids(centroids.usable(df, "vec_id", "embedding", 64, 1024), 8, "3")
    tables.next(centroids.Move(first, np.zeros(8), np.zeros(8)), 64)
    plan = tables.blocks()._jdf.queryExecution().executedPlan().toString()
    tables.drop()
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(tables.name)]
