"""Operators 4 and 9: substring dedup and near-dedup, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from geolith.llm import common, near_dedup, substring_dedup, words
from geolith.llm.words import Words, pieces

SCHEMA = "doc_id long, text string, n long, bucket string, kept string, key long, doc long, rep long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4) for r in rows], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("lower", [False, True])
def test_words(lower):
    texts = ["a B\tc", None, "", "  ", "é x \x1cy", "B", "x" * 5000, "a B\tc "]
    w = Words(pa.array(texts), lower)
    for i, t in enumerate(texts):
        assert [x.decode() for x in w.split(i)] == split(t) and w.counts[i] == len(split(t))
    low = re.sub("[A-Z]", lambda m: m[0].lower(), "\n".join(x for t in texts for x in split(t))) if lower else "\n".join(x for t in texts for x in split(t))
    assert len(set(w.hash.tolist())) == len(set(low.split("\n")))
    col = pa.array(["ab"] * 10 + ["c" * 50] + [None])
    assert [x.as_py() for _, p in pieces(col, 8, 3) for x in p] == col.to_pylist()
    assert pa.chunked_array([p for _, p in pieces(col.slice(2), 8, 3)]).to_pylist() == col.slice(2).to_pylist()


def test_words_in_blocks_of_any_size(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        monkeypatch.setattr(words, "BYTES", rng.choice([3, 7, 16, 1 << 20]))
        monkeypatch.setattr(words, "RUNS", rng.choice([2, 5, 1 << 18]))
        monkeypatch.setattr(words, "LONG", rng.choice([4, 256]))
        texts = ["".join(rng.choice("ab \n\tÀé") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(0, 6))]
        w, own = Words(pa.array(texts, pa.string())), [x for t in texts for x in split(t)]
        assert [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == own and w.counts.tolist() == [len(split(t)) for t in texts]
        for n, run in ((1, lambda at: w.hash[at]), (2, lambda at: w.runs(at, 2)), (3, lambda at: w.runs2(at, 3))):
            at = np.flatnonzero(w.left() >= n)
            assert len(set(zip(*(own[k : len(own) - n + k + 1] for k in range(n)))) if n == 1 else {tuple(own[i : i + n]) for i in at}) == len(set(run(at).tolist()))


def test_words_that_collide_in_polynomials_differ():
    """Two words of the Thue-Morse sequence have one polynomial hash modulo 2**64, whatever its base."""
    bits = [bin(i).count("1") & 1 for i in range(1 << 12)]
    w = Words(pa.array(["".join("ab"[b] for b in bits) + " " + "".join("ba"[b] for b in bits)]))
    assert w.hash[0] != w.hash[1] and len(set(w.runs2(np.arange(2), 1).tolist())) == 2


def test_long_texts_take_little_memory():
    """A text of 40 MB of words takes a few times its size; a child process is measured."""
    import subprocess
    import sys

    code = "import resource, pyarrow as pa, numpy as np\nfrom geolith.llm import language_id, near_dedup\nrng = np.random.default_rng(1)\ncol = pa.array([' '.join(map(str, rng.integers(0, 10**9, 4_000_000)))])\n" \
           "peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024\na = peak()\nlanguage_id.counts(col)\nnear_dedup.shingle_sets(col, 5)\nprint(peak() - a)"
    used = int(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout)
    assert used < 500, used


def test_the_cover_is_perfect():
    got = sorted((a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER if a != b)
    assert got == list(range(1, substring_dedup.PERIOD))


def brute_substrings(rows, n):
    least = {}
    key = lambda d: float("inf") if d is None else d
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(least.get(k, float("inf")), key(doc))
    out = []
    for doc, text in rows:
        w = split(text)
        gone = {j for i in range(len(w) - n + 1) if least[tuple(w[i : i + n])] < key(doc) for j in range(i, i + n)}
        out.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef é gh ij Kl mn".split()) + str(rng.randrange(60))
    shared = [[word() for _ in range(k)] for k in (50, 51, 80, 200, 49)]
    rows = []
    for i in range(60):
        parts = [[word() for _ in range(rng.randrange(0, 90))]]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            cut = rng.randrange(0, 20)
            parts += [p[cut:] if rng.random() < 0.5 else p, [word() for _ in range(rng.randrange(0, 40))]]
        rows.append((rng.randrange(45), rng.choice([" ", "\n", "\t "]).join(x for p in parts for x in p)))
    one = " ".join(shared[3])
    return rows + [(None, None), (70, ""), (71, " \n"), (5, one), (5, one), (None, one), (None, one), (80, "a " * 3000), (81, "a " * 49), (82, "a " * 50), (3, None), (90, "w" * 20_000 + " x" * 60)]


@pytest.mark.parametrize("seed,window", [(1, 50), (2, 50), (3, 31)])
def test_substring_dedup(spark, seed, window):
    rows = passages(seed)
    got = substring_dedup.dedup(frame(spark, rows), window, buckets=7).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_substrings(rows, window)
    for r in got:
        assert sum(b - a for a, b in zip(r.removed[::2], r.removed[1::2])) == r.n_removed
    assert substring_dedup.dedup(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup(frame(spark, rows), 30)


def test_buckets_over_two_gib_are_never_put_together():
    class Bucket(substring_dedup.Bucket):
        def pieces(self):
            return iter(())

    chunk = pa.array(["x" * (1 << 28)])
    text = pa.chunked_array([chunk] * 9 + [pa.array(["a", None, "b"])])
    got = Bucket(pa.table({"doc_id": pa.array(range(12)), "text": text}), 50)
    assert [i for i, part in got.parts for i in range(i, i + len(part))] == list(range(12))


def test_buckets_have_a_set_size(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 100_000) for i in range(40)], "doc_id long, text string")
    assert substring_dedup.bucket_number(df) == 8  # two for each of four partitions
    monkeypatch.setattr(substring_dedup, "BUCKET_MB", 1)
    assert substring_dedup.bucket_number(df.unionByName(df).unionByName(df)) == 12
    rows = passages(4)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(frame(spark, rows), buckets=500).collect()), key=str) == brute_substrings(rows, 50)


def brute_components(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    node = [("id", d) if d is not None else ("row", s and sorted(s)[0], len(s), frozenset(s)) for (d, _), s in zip(rows, sets)]
    for i in range(len(rows)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if union and 100 * both >= percent * union:
                a, b = find(node[i]), find(node[j])
                top[a] = b
    least = {}
    for (d, _), x in zip(rows, node):
        r = find(x)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    out = []
    for (d, _), s, x in zip(rows, sets, node):
        c = least.get(find(x)) if s else d
        out.append((d, len(s), c, d == c))
    return sorted(out, key=str)


def near_rows(seed, n=120):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 40, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(w) // 8)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(2000)}"
        rows.append((i, " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()))
    chain = [f"c{j}" for j in range(60)]
    for i in range(12):  # each links to the next one only
        rows.append((500 + i, " ".join(chain)))
        chain = chain[5:] + [f"d{i}-{j}" for j in range(5)]
    return rows + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one"), (905, " \t"), (906, "x " * 30_000), (907, "x " * 40_000), (908, "x"), (2, rows[2][1]), (950, rows[0][1])]


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 5)])
def test_near_duplicates(spark, seed, k):
    rows = near_rows(seed)
    got = near_dedup.near_duplicates(frame(spark, rows), k).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, k)
    assert len({r.component_id for r in got if 500 <= r.doc_id < 512}) == 1


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "lonely text of some words"), (None, None), (7, "q r s"), (7, "t u v"), (8, "q r s")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {(None, 5, 4, False), (4, 5, 4, True), (None, 4, None, True), (None, 0, None, True), (7, 2, 7, True), (8, 2, 7, False)}
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    kept = near_dedup.one_of_each(frame(spark, rows), 2)
    assert kept.columns == frame(spark, rows).columns  # one row of each group: the first null id goes with 4, and 7 stays with either text
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("4", "a b c d e f"), ("7", "q r s"), ("7", "t u v"), ("None", "None"), ("None", "lonely text of some words")]
    rows = [(3, "a b c"), (7, "a b c"), (7, "other words here"), (None, "x y z"), (None, "x y z"), (9, "e f g"), (9, "e f g")]
    assert sorted((str(r.doc_id), r.text) for r in near_dedup.one_of_each(frame(spark, rows), 2).collect()) == [("3", "a b c"), ("7", "other words here"), ("9", "e f g"), ("None", "x y z")]


@pytest.mark.parametrize("seed,k", [(3, 2)])
def test_hot_keys_change_no_row(spark, seed, k, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    rows = near_rows(seed)
    assert sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows), k).collect()), key=str) == brute_components(rows, k)
    left, right = spark.range(100).selectExpr("id % 3 as k", "id"), spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, v string")
    hot = common.hot_keys(left, "k")
    assert hot.count() == 3
    for how in ("inner", "left"):
        assert sorted(map(str, common.join_hot(left, right, "k", hot, "id", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    assert common.hot_keys(left.where("id % 3 = 0 or id < 10"), "k").count() == 1 and common.hot_keys(right, "k") is None


def test_hot_groups_take_rounds(spark):
    """A group of many near copies that do not all link with one centre."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(100)] = f"z{i}-{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows), 2).collect()), key=str) == brute_components(rows, 2)


def test_sketches_estimate_similarity(spark):
    rng = np.random.default_rng(1)
    limit = near_dedup.odd_limit(0.8)
    for similar in (0.8, 0.9, 1.0):
        n = 900
        common = int(2 * n * similar / (1 + similar))
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 1 << 63, n - common, np.uint64)])
        m = near_dedup.minhashes(np.concatenate([a, b]), np.array([0, n]))
        odd = near_dedup.odd_sketches(m)
        bits = int(np.unpackbits((odd[0] ^ odd[1]).view(np.uint8)).sum())
        assert bits <= limit
        df = spark.createDataFrame([(odd[0].tolist(), odd[1].tolist())], "a array<long>, b array<long>")
        assert abs(df.select(near_dedup.similarity_of(df.a, df.b).alias("s")).first().s - similar) < 0.12
    a, b = rng.integers(0, 1 << 63, 900, np.uint64), rng.integers(0, 1 << 63, 900, np.uint64)
    odd = near_dedup.odd_sketches(near_dedup.minhashes(np.concatenate([a, b]), np.array([0, 900])))
    assert int(np.unpackbits((odd[0] ^ odd[1]).view(np.uint8)).sum()) > limit


def test_near_copies_are_compared_with_their_common_text(spark, monkeypatch):
    """Copies that link with one text but not with each other take few pairs, wherever that text's id lies."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(240)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(240, 0 if i == 80 else 11, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    counts, real = [], near_dedup.stored

    def stored(df, name, **options):
        out = real(df, name, **options)
        counts.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(near_dedup, "stored", stored)
    got = near_dedup.near_duplicates(frame(spark, rows), 2).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 160
    assert sum(counts) <= 10 * len(rows)
