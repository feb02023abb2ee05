"""Whitening, language identification and the manifest against plain statements, and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import language_id, merkle, queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, dims int, component int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, digest string, `size` int"


# ---- whitening


def plain_integers(vector):
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector)


def plain_covariance(fit):
    """Exact products of the centred integers, without polarisation."""
    n, dims = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(dims)]
    apart = [[n * x[i] - s[i] for i in range(dims)] for x in fit]
    return s, np.array([[sum(a[i] * a[j] for a in apart) / n**3 for j in range(dims)] for i in range(dims)])


def vectors(rng, n, dims):
    mixing = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(dims)]
    made = []
    for _ in range(n):
        raw = [rng.gauss(0, 1 + k) for k in range(dims)]
        made.append([sum(a * b for a, b in zip(line, raw, strict=True)) for line in mixing])
    return made


def check_whitening(rows, got, components):
    whole = {k: x for k, v in rows if (x := plain_integers(v)) is not None}
    fit = sorted(set(whole.values()))
    n, dims = len(fit), len(fit[0])
    s, v = plain_covariance(fit)
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == sum(1 for _, v in rows if plain_integers(v) is not None) * min(components, dims)
    by_row = defaultdict(dict)
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(v)) <= 1e-9
        assert int(r["deviation"]) == sum((n * a - b) ** 2 for a, b in zip(whole[r["vec_id"]], s, strict=True))
        by_row[r["vec_id"]][r["component"]] = r["whitened"]
    # Recover the components from the results, then check them against the covariance.
    x = np.array([[float(n * a - b) / n for a, b in zip(whole[k], s, strict=True)] for k in by_row])
    y = np.array([[line[c] for c in sorted(line)] for line in by_row.values()])
    axes = np.linalg.lstsq(x, y, rcond=None)[0] * np.sqrt(values[: y.shape[1]])
    assert np.abs(axes.T @ axes - np.eye(y.shape[1])).max() < 1e-6
    assert np.abs(v @ axes - axes * values[: y.shape[1]]).max() < 1e-6 * values[0]


def test_whitening(spark):
    rng = random.Random(5)
    made = vectors(rng, 300, 6)
    rows = list(enumerate(made + made[:50] + [made[0]] * 40))
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (903, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(k, v, 1, "x", 3, 9) for k, v in rows], VECTORS).repartition(3)
    check_whitening(rows, whitening.whitened(df, components=4).collect(), 4)
    check_whitening(rows, whitening.whitened(df).collect(), 16)


def test_whitening_registered(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(rows, queries.QUERIES["op11_whitening"](spark, sf_dir).collect(), 16)


def test_whitening_odd(spark):
    def run(rows, **how):
        return whitening.whitened(spark.createDataFrame([(k, v, 1, "x", 3, 9) for k, v in rows], VECTORS), **how).collect()

    assert run([]) == [] and run([(1, None), (2, [float("nan")])]) == [] and run([(1, [])]) == []
    # One vector has no variance; a null id stays; rows of the less frequent length go.
    got = run([(None, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])])
    assert [(r["vec_id"], r["component"]) for r in sorted(got, key=lambda r: (r["vec_id"] or 0, r["component"]))] == [(None, 1), (None, 2), (2, 1), (2, 2)]
    assert {(r["n"], r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in got} == {(1, None, 0.0, 0.0, 0)}
    # Two lengths equally often: the longer one stays.  Beyond 2^62 / 64 there is no integer.
    assert {r["vec_id"] for r in run([(1, [1.0]), (2, [1.0, 2.0]), (3, [1e30, 1.0])])} == {2}
    # A third dimension that the others determine has no variance of its own.
    got = run([(k, [float(k % 7), float(k % 5), float(k % 7)]) for k in range(35)])
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    # Large entries leave the range of 64-bit squares; the sums stay exact.
    large = [(k, [float(v) for v in (2**40 * (k % 3), 2**41 + 2**30 * (k % 4))]) for k in range(12)]
    check_whitening(large, run(large), 16)


def test_polarised_sums():
    rng = np.random.default_rng(3)
    for scale in (100, 2**34):
        d = rng.integers(-scale, scale, (50, 4))
        found = whitening.squares(d)
        exact = d.astype(object)
        for i in range(4):
            assert found[i][0] == (exact[:, i] ** 2).sum()
            assert [found[i][j - i] for j in range(i + 1, 4)] == [((exact[:, i] + exact[:, j]) ** 2).sum() for j in range(i + 1, 4)]


# ---- language identification


def plain_grams(text):
    lower, word = text.lower(), ""
    for c in lower:
        word += c if c.isalpha() else " "
    padded = f" {' '.join(word.split())} " if word.split() else " "
    found = Counter(c for c in padded if c != " ")
    for n in (2, 3):
        found.update(padded[k : k + n] for k in range(len(padded) - n + 1))
    return found


def feature(gram):
    key = len(gram)
    for c, step in zip(gram, language_id._STEPS.tolist(), strict=False):
        key = (key + ord(c)) * step % 2**64
        key ^= key >> 29
    return (key * int(language_id._STEPS[0]) % 2**64) >> (64 - language_id.BITS)


def test_grams():
    rng = random.Random(8)
    texts = ["", None, "  12 ..", "Éa, b!", "x", "İ ß"] + ["".join(rng.choices("aBéñ ,.1\n日", k=rng.randint(0, 40))) for _ in range(200)]
    row, features, counts, seen = language_id.grams(texts)
    got = defaultdict(dict)
    for r, f, c in zip(row.tolist(), features.tolist(), counts.tolist(), strict=True):
        got[r][f] = c
    for k, text in enumerate(texts):
        plain = Counter()
        for gram, count in plain_grams(text or "").items():
            plain[feature(gram)] += count
        assert got.get(k, {}) == plain, text
        assert seen[k] == any(c.isalpha() for c in text or "")


def test_update():
    """One step against a scalar statement of the regularised leader for every class."""
    rng = random.Random(2)
    how = language_id.Training()
    z, n = np.zeros((6, 3)), np.zeros((6, 3))
    plain_z, plain_n = [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]
    for _ in range(60):
        held = sorted(rng.sample(range(5), 3)) + [5]
        value = [rng.random() for _ in held]
        label = rng.randrange(3)
        language_id.update(np.array(held), np.array(value), label, z, n, how)
        w = {}
        for f in held:
            for k in range(3):
                a, b = plain_z[f][k], plain_n[f][k]
                w[f, k] = 0.0 if abs(a) <= how.l1 else -(a - math.copysign(how.l1, a)) / ((how.beta + math.sqrt(b)) / how.alpha + how.l2)
        e = [math.exp(sum(v * w[f, k] for f, v in zip(held, value, strict=True))) for k in range(3)]
        for f, v in zip(held, value, strict=True):
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == label))
                sigma = (math.sqrt(plain_n[f][k] + g * g) - math.sqrt(plain_n[f][k])) / how.alpha
                plain_z[f][k] += g - sigma * w[f, k]
                plain_n[f][k] += g * g
    assert np.allclose(z, plain_z) and np.allclose(n, plain_n)


def test_frequencies_and_temperature(spark):
    texts = ["ab", "ab ab", "b", "", None]
    n, held = language_id.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    plain = Counter(f for t in texts for f in {feature(g) for g in plain_grams(t or "")})
    assert n == 5 and {k: v for k, v in enumerate(held) if v} == plain
    # Right in nine cases of ten at logits 1 and 0: the probability of the first should be 0.9.
    sums = 9 * language_id.doubts(np.array([1.0, 0.0]), 0) + language_id.doubts(np.array([1.0, 0.0]), 1)
    t = language_id.temperature(10**6, *(sums * 10**5))
    assert abs(1 / (1 + math.exp(-1 / t)) - 0.9) < 0.01
    # All right: the scores stay below 1.
    sums = 20 * language_id.doubts(np.array([4.0, 0.0]), 0)
    assert 0.9 < 1 / (1 + math.exp(-4 / language_id.temperature(20, *sums))) < 0.999


def test_language_registered(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op12_language_id"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd(spark):
    def frame(rows):
        return spark.createDataFrame([(i, t, l, "s", 1, "t", 1, "d", 1) for i, t, l in rows], DOCS)

    assert language_id.identified(frame([])).collect() == []
    unknown = language_id.identified(frame([(1, "abc", None), (None, "abc", "en"), (2, None, "en"), (3, "12", None)])).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in unknown} == {(1, "und", 0.0), (None, "und", 0.0), (2, "und", 1.0), (3, "und", 1.0)}
    rng = random.Random(1)
    words = {"aa": ["kala", "maka", "lama"], "bb": ["zuru", "ruzu", "urzu"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randint(1, 9))), lang) for k in range(400) for lang in [rng.choice(["aa", "bb"])]]
    # A text of a third of all rows, a very long text, nulls, repeated rows.
    rows += [(1000 + k, "kala maka kala", "aa") for k in range(200)] + [(2000, "zuru " * 200_000, None), (2001, None, "aa"), (2002, "", "bb"), (2003, "maka", None), (2003, "maka", None)]
    got = language_id.identified(frame(rows).repartition(5))
    found = defaultdict(set)
    for r in got.collect():
        found[r["doc_id"]].add((r["lang_pred"], r["score"]))
    assert got.count() == len(rows)
    assert {x for x, _ in found[2000]} == {"bb"} and {x for x, _ in found[2003]} == {"aa"} and len(found[2003]) == 1
    assert found[2001] == found[2002] == {("und", 1.0)}
    right = [lang == next(iter(found[k]))[0] for k, t, lang in rows if lang and t]
    assert sum(right) >= 0.98 * len(right)
    again = language_id.identified(frame(rows).repartition(2)).collect()
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in again) == Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in got.collect())


# ---- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """The last node and, for each first one, its way up as (siblings before, siblings behind)."""
    ways, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            first = p - p % 2
            ways[k].append((nodes[first:p], nodes[p + 1 : first + 2]))
            place[k] = p // 2
        nodes = [sha("".join(nodes[p : p + 2])) for p in range(0, len(nodes), 2)]
    return nodes[0], ways


def plain_manifest(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        tampered = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id, plain_leaf(doc_id, source, lang, n_chars + 1, text) if tampered else leaf))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [(sorted(groups[lang], key=lambda g: g[:3]), lang) for lang in langs]
    tops = [plain_tree([g[2] for g in group]) for group, _ in trees]
    root, upper = plain_tree([top for top, _ in tops])
    found = []
    for (group, _), (subroot, ways), above in zip(trees, tops, upper, strict=True):
        for (_, _, leaf, doc_id, shown), way in zip(group, ways, strict=True):
            now = shown
            for before, behind in way + above:
                now = sha("".join([*before, now, *behind]))
            siblings = "".join("".join(a + b) for a, b in way + above)
            found.append((doc_id, leaf, subroot, root, sha(siblings), now, now == root))
    return Counter(found)


def manifest(spark, rows, **how):
    df = spark.createDataFrame([(i, t, l, s, n, "t", 1, "d", 1) for i, t, l, s, n in rows], DOCS).repartition(5)
    changed = [(F.col("n_chars").cast("decimal(20,0)") + 1).cast("string") if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    got = merkle.manifest(df, F.when(tampered, F.sha2(merkle.encoded(changed), 256)), **how)
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block", [2, 4, 1024])
def test_manifest(spark, block):
    rng = random.Random(block)
    langs = [None, "", "-", "=", "de", "en", "é", "日本", "😀", "ﬀ"]
    rows = [(rng.choice([None, *range(-50, 200)]), rng.choice([None, "", "é\nx", "a" * 70_000]), rng.choice(langs + ["en"] * 12), rng.choice([None, "s"]), rng.choice([None, 0, 2**63 - 1])) for _ in range(150)]
    rows += [(7, "same", "en", "s", 4)] * 40
    expected = plain_manifest(rows)
    assert manifest(spark, rows, block=block) == expected
    assert {k[6] for k in expected} == {True, False}


def test_manifest_odd(spark):
    assert manifest(spark, []) == Counter()
    for rows in ([(1, "x", "en", "s", 1)], [(None, None, None, None, None)] * 3, [(k, "x", str(k), "s", 1) for k in range(9)], [(2**62 + k, "x", "en", None, None) for k in range(5)]):
        assert manifest(spark, rows) == plain_manifest(rows)
        assert manifest(spark, rows, block=2) == plain_manifest(rows)


def test_manifest_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = queries.QUERIES["op13_merkle"](spark, sf_dir)
    result = connection.execute(queries.ORACLES["op13_merkle"])
    assert [c[0] for c in result.description] == df.columns
    assert Counter(map(tuple, result.fetchall())) == Counter(map(tuple, df.collect()))
