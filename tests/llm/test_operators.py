"""The operators against plain statements of their results, and their edge cases."""

import base64
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from claimloom.llm import binary, chat, decontaminate, graph, jaccard, line_dedup, mixing, quality_classifier, quality_rules, queries, sharding, url_filters
from claimloom.llm import words as w
from claimloom.session import _shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, `size` int, token string, shard string"
VOCABULARY = [f"w{k}" for k in range(300)]


def frame(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 1, "t", "old") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(random.Random(1).choices(VOCABULARY, k=30_000))
    rows = [(None, None, None), (None, "a b c", "s"), (1, "", "s"), (2, " \t\n", None), (3, "one", "s"), (3, "one", "s"), (4, long, "s"), (5, long, "t"), (5, long + " end", "t"), (6, "Ä é\nx", "t")]
    return frame(spark, rows)


def plain_words(text):
    return [x.decode() for x in (text or "").encode().split()]


def near_copies(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = rng.choices(VOCABULARY, k=rng.randint(1, 60))
        if rows and rng.random() < 0.7:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(VOCABULARY)
        rows.append((k, " ".join(text)))
    return rows


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        x = [c.lower() for c in plain_words(t)]
        sets[i] = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} or ({tuple(x)} if x else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_jaccard(spark, seed, n, percent):
    rows = near_copies(seed)
    df = frame(spark, [(i, t, "s") for i, t in rows])
    got = {tuple(r) for r in jaccard.near_duplicates(df, like=jaccard.Similarity(n, percent)).collect()}
    expected = brute_components(rows, n, percent)
    assert got == expected
    assert len({c for _, _, c in expected}) < len(rows)
    kept = {r["doc_id"] for r in jaccard.keep_one(df, like=jaccard.Similarity(n, percent)).collect()}
    assert kept == {c for _, _, c in expected}


def test_jaccard_odd(spark, odd):
    got = Counter(tuple(r) for r in jaccard.near_duplicates(odd).collect())
    assert sum(got.values()) == odd.count()
    assert got[(3, 1, 3)] == 2 and got[(1, 0, 1)] == 1 and got[(None, 0, None)] == 1 and got[(None, 1, None)] == 1
    assert {r[2] for r in got if r[0] in (4, 5)} == {4}
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, None, 1, 2, 3, 4, 6])
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def plain_report(text):
    x = plain_words(text)
    windows = [tuple(x[k : k + 3]) for k in range(len(x) - 2)]
    many = Counter(windows)
    inside = {k + d for k, g in enumerate(windows) if many[g] > 1 for d in range(3)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if plain_words(line):
            lines += line in seen
            seen.add(line)
    failed = len(x) < 50 or 100 * len(inside) > 50 * len(x)
    return len(x), sum(map(len, x)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(inside), failed


def test_quality_rules(spark, odd):
    rng = random.Random(3)
    made = [(k, " ".join(rng.choices(VOCABULARY[: rng.choice((5, 300))] + ["é#", "\n", "x|y"], k=rng.randint(0, 300))), "s") for k in range(60)]
    for df in (frame(spark, made), odd):
        texts = Counter((r["doc_id"], *plain_report(r["text"])) for r in df.collect())
        report = quality_rules.rule_report(df).collect()
        assert Counter(tuple(r)[:7] for r in report) == texts
        kept = quality_rules.keep(df)
        assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in report)
    assert quality_rules.rule_report(odd.limit(0)).count() == 0


def test_bands():
    judge = lambda x: quality_rules.judge(x, quality_rules.Bands(), zstandard.ZstdCompressor(level=3))[3]
    rng = random.Random(4)
    prose = " ".join("".join(rng.choices(["the", "an", "stor", "ly", "ing", "er", "ed", "wh", "tion", "of", "re"], k=rng.randint(1, 4))) for _ in range(4000)).encode()
    assert not judge(b"again and again " * 3000) and not judge(random.Random(5).randbytes(50_000))
    assert not judge(prose[:9000] + b"x" * 30_000) and judge(prose) and judge(b"")


def test_bands_by_length(spark, sf_dir):
    rng = random.Random(11)
    printable = [chr(x) for x in range(33, 127)]
    letters = [x for x in printable if x.isalpha()]
    drawn = lambda signs, n: " ".join("".join(rng.choices(signs, k=rng.randint(2, 9))) for _ in range(n // 6))
    encoded = lambda n: re.sub("(.{11})", r"\1 ", base64.b64encode(rng.randbytes(n)).decode())
    lines = lambda n: re.sub("(.{76})", r"\1\n", base64.b64encode(rng.randbytes(n)).decode())
    made = [drawn(printable, n) for n in (350, 500, 700, 1_300, 2_500, 5_000, 40_000)]
    made += [encoded(n) for n in (500, 700, 1_300, 2_500, 5_000, 40_000)] + [lines(n) for n in (5_000, 40_000)]
    made += [drawn(letters, n) for n in (2_500, 5_000, 40_000)]
    report = quality_rules.rule_report(frame(spark, [(k, x, "s") for k, x in enumerate(made)])).collect()
    assert not any(r["base_failed"] for r in report) and not [r for r in report if r["kept"]]
    docs = queries.table(spark, sf_dir, "documents")
    clean = quality_rules.rule_report(docs).where("not base_failed").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r["lang"] for r in clean} >= {"en", "de", "fr", "es"} and sum(r["kept"] for r in clean) >= 0.99 * len(clean)


def test_lower_bands(spark):
    """Texts that no base rule rejects, as no three words come again, and that say next to nothing."""

    def rounds(words):
        """Every three words in a row once (a de Bruijn sequence)."""
        found, held = [], [0] * 4 * len(words)

        def go(t, p):
            if t > 3:
                found.extend(held[1 : p + 1] if 3 % p == 0 else [])
                return
            held[t] = held[t - p]
            go(t + 1, p)
            for j in range(held[t - p] + 1, len(words)):
                held[t] = j
                go(t + 1, t)

        go(1, 1)
        return [words[k] for k in found]

    names = ["administration", "communication", "representation", "transformation", "characteristic", "responsibility", "infrastructure", "recommendation", "implementation", "identification"]
    made = [" ".join(rounds(names)), "\n".join(" ".join(rounds(names[:n])) for n in (4, 6, 9))]
    report = quality_rules.rule_report(frame(spark, [(k, x, "s") for k, x in enumerate(made)])).orderBy("doc_id").collect()
    assert not report[0]["base_failed"] and not report[0]["kept"] and report[0]["ratio"] < 0.2
    wide = quality_rules.Rules(bands=quality_rules.Bands(whole=((0, 0.0, 9.9),), chunk=(0.0, 9.9)))
    assert quality_rules.rule_report(frame(spark, [(0, made[0], "s")]), rules=wide).first()["kept"]


def edits(rng, item, k):
    text = list(item)
    for _ in range(k):
        at = rng.randrange(len(text))
        kind = rng.random()
        if kind < 0.4:
            text[at] = rng.choice(VOCABULARY)
        elif kind < 0.7:
            del text[at]
        else:
            text.insert(at, rng.choice(VOCABULARY))
    return text


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_decontamination_recall_and_exactness(spark):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choices(VOCABULARY, k=rng.randint(5, 40)))) for k in range(25)]
    rows = []
    for k in range(150):
        text = rng.choices(VOCABULARY, k=rng.randint(0, 40))
        item = rng.choice(items)[1].split()
        if rng.random() < 0.8:
            text += edits(rng, item, rng.randint(0, len(item) // 4))
        rows.append((k, " ".join(text + rng.choices(VOCABULARY, k=rng.randint(0, 30))), "s"))
    expected = {}
    for i, t, _ in rows:
        x = t.split()
        for j, u in items:
            y = u.split()
            best = min(((plain_distance(y, x[s : s + len(y)]), s) for s in range(len(x))), default=(99, 0))
            if best[0] <= len(y) * 20 // 100:
                expected[i, j] = best
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start"]) for r in decontaminate.matches(df, benchmark).collect()}
    assert len(expected) > 60
    assert set(got) <= set(expected) and len(got) >= 0.97 * len(expected)
    assert sum(got[k] == expected[k] for k in got) >= 0.97 * len(got)
    kept = decontaminate.clean(df, benchmark)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in rows} - {i for i, _ in got}


def test_decontamination_candidates(monkeypatch):
    rng = random.Random(12)
    words = [f"v{k}" for k in range(20_000)]
    for n, most in ((40, 0.6), (100, 0.3)):
        texts = [rng.choices(words, k=n) for _ in range(60)]
        items = decontaminate.Items.of(list(range(60)), [" ".join(x) for x in texts], decontaminate.Search())
        k, compared = n * 20 // 100, []
        cut = slice(n * (k // 2) // (k + 1), n * (k // 2 + 1) // (k + 1))  # a segment
        plain = decontaminate.distances
        with monkeypatch.context() as patch:
            patch.setattr(decontaminate, "distances", lambda item, windows, plain=plain, compared=compared: compared.append(1) or plain(item, windows))
            chance = [" ".join(rng.choices(words, k=n) + x[cut] + rng.choices(words, k=n)) for x in texts]
            assert len(items.places(decontaminate._words(pa.array(chance)))[0]) >= 60
            assert not items.matches(pa.array(chance)) and len(compared) <= most * len(texts)
        near = [list(x) for x in texts]
        for x in near:
            for at in rng.sample(range(n), k):
                x[at] = rng.choice(words)
        near = [" ".join(rng.choices(words, k=9) + x + rng.choices(words, k=9)) for x in near]
        found = items.matches(pa.array(near))
        assert sum((r, r) in found for r in range(60)) >= 0.99 * 60


def test_decontamination_odd(spark, odd):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "ONE!"), (None, "a, b c")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.matches(odd, benchmark).collect())
    assert got == Counter({(3, 3): 2, (None, None): 1})
    assert decontaminate.matches(odd.limit(0), benchmark).count() == 0
    assert decontaminate.matches(odd, benchmark.limit(0)).count() == 0


def test_sharding(spark, odd):
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 997)
    counts = Counter(table.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 997)
    stay = table != 6
    assert (fewer[stay] == table[stay]).mean() > 0.75
    placed = sharding.place(odd, names, size=997)
    assert placed.count() == odd.count() and Counter(placed.columns) == Counter([*odd.columns, "slot"])
    assert all(r["shard"] == names[table[r["slot"]]] for r in placed.collect())
    assert placed.where("doc_id = 3").select("slot").distinct().count() == 1
    assert sharding.place(odd.limit(0), names).count() == 0


def test_turns_of_the_shards():
    """Every shard's order of preference written out, and the claims one after the other."""
    names, size = ["a", "b", "c", "d", "e"], 101
    own = {}
    for x in names:
        first, step = sharding._hash(x, "first") % size, sharding._hash(x, "step") % (size - 1) + 1
        own[x] = [(first + k * step) % size for k in range(size)]
        assert sorted(own[x]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for x in names:
            free = [slot for slot in own[x] if slot not in owner]
            if free:
                owner[free[0]] = x
    assert [names[k] for k in sharding.lookup_table(names, size)] == [owner[k] for k in range(size)]


def test_mixing(spark, odd):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 40))), rng.choice(["a"] * 20 + ["b", None, "c", "ß"])) for k in range(3000)]
    mix = mixing.mix(frame(spark, rows)).collect()
    by = {}
    for r in mix:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(sum(r["size"] for r in mix))
    for x in by.values():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 40 and x[0]["target"] <= 3 * x[0]["source_size"]
    out = mixing.mixed(odd)
    wanted = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() == wanted.agg(F.sum("copies")).first()[0]
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_takes_no_more_than_the_epochs(spark):
    """Empty texts of a clamped source, and a source of empty texts alone."""
    rows = [(k, "", "b") for k in range(300)] + [(300 + k, "x y", "b") for k in range(20)]
    rows += [(1000 + k, "w " * 50, "a") for k in range(200)] + [(2000 + k, None, "c") for k in range(30)]
    df = frame(spark, rows)
    mix = mixing.mix(df).collect()
    assert max(r["copies"] for r in mix) == 3 and {r["copies"] for r in mix if r["source"] == "b"} == {3}
    assert {(r["target"], r["copies"]) for r in mix if r["source"] == "c"} == {(0.0, 0)}
    connection = duckdb.connect()
    connection.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    connection.executemany("insert into documents values (?, ?, ?)", rows)
    result = connection.execute(queries.ORACLES["op5_mixing"])
    columns = [c[0] for c in result.description]
    assert Counter(result.fetchall()) == Counter(tuple(r[c] for c in columns) for r in mix)
    assert "NestedLoop" not in mixing.mix(df)._jdf.queryExecution().executedPlan().toString()


def test_classifier(spark, odd):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.7
        rows.append((k, " ".join(x if good else x.upper() + "!!" for x in rng.choices(VOCABULARY, k=50)), "s"))
        labels.append((k, int(good)))
    labels = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    got = quality_classifier.scored(frame(spark, rows), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.95
    scores = quality_classifier.scored(odd, labels).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert {r["score"] for r in quality_classifier.scored(odd, labels.limit(0)).collect()} == {0.5}


def test_classifier_update():
    """One example after the other against a scalar statement of the regularised leader."""
    rng = random.Random(13)
    how = quality_classifier.Training()
    z, n, plain = np.zeros(6), np.zeros(6), [[0.0, 0.0] for _ in range(6)]
    for _ in range(80):
        held = sorted(rng.sample(range(5), 3)) + [5]
        values, label = [rng.random() * 4 for _ in held], rng.randrange(2)
        quality_classifier.update(np.array(held), np.array(values), label, z, n, how)
        weight = {}
        for f in held:
            a, b = plain[f]
            weight[f] = 0.0 if abs(a) <= how.l1 else -(a - np.sign(a) * how.l1) / ((how.beta + b**0.5) / how.alpha + how.l2)
        p = 1 / (1 + np.exp(-sum(weight[f] * v for f, v in zip(held, values, strict=True))))
        for f, v in zip(held, values, strict=True):
            g = (p - label) * v
            plain[f][0] += g - ((plain[f][1] + g * g) ** 0.5 - plain[f][1] ** 0.5) / how.alpha * weight[f]
            plain[f][1] += g * g
    assert np.allclose(np.stack([z, n], axis=1), plain)


def test_classifier_on_the_given_labels(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf_dir, "labels").collect()}
    got = [r for r in queries.QUERIES["op4_quality_classifier"](spark, sf_dir).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(got) > 5 and sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.9 * len(got)


def test_checksums():
    assert binary.checksums([b"123456789"])[0] == 0xE3069283
    assert binary.checksums([b"\0" * 32, b"\xff" * 32]).tolist() == [0x8A9136AA, 0x62A8AB43]
    rng = random.Random(9)
    step, _ = binary._checksum_tables()
    for n in (4, 255, 256, 257, 1000):
        x, c = rng.randbytes(n), 0xFFFFFFFF
        for b in x:
            c = int(step[(c ^ b) & 255]) ^ (c >> 8)
        assert binary.checksums([b"zzzz", x])[1] == c ^ 0xFFFFFFFF


def test_binary(spark, odd):
    tokenizer = binary.Encoder(queries.tokenizer_file())
    texts = ["", " ", "a  b", "x\n\ny \n", "it's 12   z　k", "tab\tx \x1c y", "é<|endoftext|>", "\r\n a"]
    whole = [tokenizer.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, tokenizer.type).tolist() for x in tokenizer.encode(texts)] == whole
    folder = binary.new_folder(spark, _shared_folder(spark))
    files = binary.write(odd, folder, queries.tokenizer_file())
    got = sorted((tuple(r) for r in binary.read(spark, folder, files).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for (i, s, n, c), (j, t) in zip(got, rows, strict=True):
        ids = [*tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert (i, s, n, c) == (j, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += n
    part = files.first()["part"]
    assert binary.read_record(folder, part, 0)[0] is None
    broken = binary.frames([b"some payload"])[0]
    with pytest.raises(ValueError, match="checksum"):
        binary.check([broken[:14] + b"?" + broken[15:]])
    assert binary.write(odd.limit(0), binary.new_folder(spark, _shared_folder(spark)), queries.tokenizer_file()).count() == 0


def test_binary_added_tokens(spark):
    whole = Tokenizer.from_file(queries.tokenizer_file())
    mark = "<|endoftext|>"
    texts = [f"abc {mark} def", f"é{mark}", mark, mark * 2 + "  x", f"a{mark}'s\n{mark}\n", "<|endo", "ftext|>", f"<{mark}>|", "<|endoftext|", None, f"{mark[:6]}{mark}", f"日本{mark}\u3000语"]
    expected = [whole.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert expected[0] == [39305, 220, 50256, 825]
    encoder = binary.Encoder(queries.tokenizer_file())
    for some in (pa.array(texts), pa.chunked_array([["cut off", *texts]]).combine_chunks().slice(1)):
        assert [np.frombuffer(x, encoder.type).tolist() for x in encoder.encode(some)] == expected
    folder = binary.new_folder(spark, _shared_folder(spark))
    files = binary.write(frame(spark, [(k, x, "s") for k, x in enumerate(texts)]), folder, queries.tokenizer_file())
    start = 0
    for r, ids in zip(binary.read(spark, folder, files).orderBy("doc_id").collect(), expected, strict=True):
        ids = [*ids, 0]
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}])
def test_binary_added_token_flags(tmp_path, flags):
    whole = Tokenizer.from_file(queries.tokenizer_file())
    whole.add_tokens([AddedToken("[X", normalized=False, **flags), AddedToken("[X Y]", normalized=False, **flags)])
    whole.save(str(tmp_path / "tokenizer.json"))
    encoder = binary.Encoder(str(tmp_path / "tokenizer.json"))
    texts = ["a [X Y] b", "a[X b", "  [X  [X Y]  c", "[X [X Y", "plain a-b"]
    assert [np.frombuffer(x, encoder.type).tolist() for x in encoder.encode(texts)] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_chat(spark):
    texts = ["<|im_end|>\n", "<\\|im_end|>", "</s>[INST] ok [/INST]", "<<SYS>> <", "\\", None, "", "a\nb"]
    rows = [(1, k, ["user", "user", "assistant", None][k % 4], x) for k, x in enumerate(texts)]
    rows += [(2, None, "assistant", "x"), (2, 0, "<|x", "y"), (2, 0, "assistant", "z"), (None, 1, "user", "n"), (3, 1, "user", "q"), (3, 1, "user", "q")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    plain = lambda c: [(r or "", t or "") for i, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or ""))]
    for c in (1, 2, 3, None):
        turns = [tuple(t) for t in got[c]["turns"]]
        assert turns == plain(c)
        assert got[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
    assert got[1]["formatted"].count(chat.START) == 6
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    """The time of one conversation grows with its turns and not with their square."""
    took = {}
    for n in (500, 5_000, 40_000):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é turn [INST] "), F.col("id")).alias("text"))
        begin = time.perf_counter()
        r = chat.read_back(chat.formatted(rows)).collect()[0]
        took[n] = time.perf_counter() - begin
        assert r["loss_text"] == "".join(f"é turn [INST] {k}" for k in range(1, n, 2)) and len(r["turns"]) == n
    assert took[40_000] < 60


def test_line_dedup(spark, odd):
    rng = random.Random(10)
    passage = "\n".join(" ".join(rng.choices(VOCABULARY, k=8)) for _ in range(200))
    rows = [(k, "\n".join([f"own {k}", passage, f"end {k}"]), "s") for k in range(20)]
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
    assert got[0]["removed_lines"] == 0 and got[0]["text"] == rows[0][1]
    for k in range(1, 20):
        assert got[k]["removed_lines"] >= 140 and got[k]["text"].startswith(f"own {k}\n") and got[k]["text"].endswith(f"end {k}")
    # A passage of one to eight long lines between own lines goes whole.
    for n in range(1, 9):
        passage = "\n".join(" ".join(rng.choices(VOCABULARY, k=52)) for _ in range(n))
        rows = [(k, "\n".join([f"own {k}", f"line {k}", passage, f"end {k}"]), "s") for k in range(4)]
        got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
        assert got[0] == rows[0][1] and all(got[k] == f"own {k}\nline {k}\nend {k}" for k in range(1, 4))
    same = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(odd).collect() if r["doc_id"] in (1, 2, 4, 6)}
    assert same == {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] in (1, 2, 4, 6)}
    assert line_dedup.deduplicated(odd.limit(0)).count() == 0


def test_url_filters(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    rows = [
        (1, "http://A.org/es/", link("a.org")), (2, "https://x.example.org/es/1", ""), (3, "http://b.com/de/1?q#f", link("far.net")), (4, "http://b.com/fr/", None),
        (5, None, ""), (6, "no url", link("spam.com")), (7, "http://spam.com/de/", None), (8, "http://farm.net/a", link("spam.com", "SPAM.com")), (9, "http://good.net", link("a.org")),
        (10, "http://example.org/en/12", ""), (11, "http://notexample.org/es/", ""), (11, "http://notexample.org/es/", ""),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filters.judged(df, url_filters.RULES).collect()}
    verdicts = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert verdicts == {
        1: ("a.org", "/es/", "org/", "allow"), 2: ("x.example.org", "/es/1", "example.org/es/", "block"), 3: ("b.com", "/de/1", "com/de/", "block"), 4: ("b.com", "/fr/", "com/fr/", "allow"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("spam.com", "/de/", "com/de/", "block"), 8: ("farm.net", "/a", None, "block"), 9: ("good.net", "", None, "allow"),
        10: ("example.org", "/en/12", "example.org/en/1", "block"), 11: ("notexample.org", "/es/", "org/", "allow"),
    }
    assert got[8]["distrust"] == pytest.approx(0.15 * 0.85) and got[9]["trust"] == 0
    assert url_filters.judged(df.limit(0), url_filters.RULES).count() == 0


def test_url_filters_mixed_hosts(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    pages = [("bad.com", "/de/1", ""), ("bad.com", "/de/2", ""), ("bad.com", "/fr/1", link("both.net")), ("bad.com", "/it/1", ""), ("good.com", "/fr/1", link("friend.net")), ("good.com", "/fr/2", link("both.net"))]
    pages += [("good.com", "/de/1", ""), ("good.com", "/it/1", ""), ("farm.net", "/a", link("bad.com")), ("friend.net", "/a", ""), ("both.net", "/a", link("good.com", "bad.com")), ("alone.net", "/a", "")]
    df = spark.createDataFrame([(k, f"http://{h}{p}", x) for k, (h, p, x) in enumerate(pages)], "page_id long, url string, html string")
    got = url_filters.judged(df, url_filters.RULES).collect()
    masses = {"bad.com": (1 / 4, 2 / 4), "good.com": (2 / 4, 1 / 4)}
    links = [("bad.com", "both.net"), ("good.com", "friend.net"), ("good.com", "both.net"), ("farm.net", "bad.com"), ("both.net", "good.com"), ("both.net", "bad.com")]

    def plain(which, links):
        hosts = sorted({h for h, _, _ in pages})
        start = {h: 0.15 * masses.get(h, (0, 0))[which] for h in hosts}
        now = start
        for _ in range(300):
            now = {h: start[h] + 0.85 * sum(now[a] / sum(x == a for x, _ in links) for a, b in links if b == h) for h in hosts}
        return now

    trust, distrust = plain(0, links), plain(1, [(b, a) for a, b in links])
    for r in got:
        assert r["trust"] == pytest.approx(trust[r["host"]], abs=1e-4) and r["distrust"] == pytest.approx(distrust[r["host"]], abs=1e-4)
    undecided = {r["host"]: r["verdict"] for r in got if r["rule"] is None}
    assert undecided["farm.net"] == "block" and undecided["friend.net"] == undecided["alone.net"] == "allow"
    assert undecided == {h: "block" if distrust[h] > trust[h] and distrust[h] >= 0.015 else "allow" for h in undecided}
    named = url_filters.judged(df, url_filters.RULES, blocked=df.limit(0).selectExpr("url as host")).collect()
    assert {r["distrust"] for r in named} == {0.0}


def test_equal_rules(spark):
    """Of equally long rules the first one of the list counts."""
    one, two = url_filters.Rule("allow", "com", "/ab"), url_filters.Rule("block", "a.com", "/")
    df = spark.createDataFrame([(1, "http://a.com/abc", '<a data-href="http://x.net/"><a class=x href="http://y.net/">')], "page_id long, url string, html string")
    for rules in ((one, two), (two, one)):
        assert url_filters.judged(df, rules).first()["verdict"] == rules[0].verdict
    assert [r["target"] for r in url_filters.edges(df.withColumn("host", F.lit("a.com"))).collect()] == ["y.net"]


def test_words():
    texts = pa.array(["aB c", None, "", "\x0bé\tc ", "c"])
    words = w.split(texts, lower=True)
    assert words.counts.tolist() == [2, 0, 0, 2, 1] and words.keys[1] == words.keys[3] == words.keys[4]
    assert [len(x) for _, x in w.slices(texts, 4)] == [3, 1, 1]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    result = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(result.fetchall())


def test_pipeline(spark, odd, sf_dir):
    docs, seen = odd, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{_shared_folder(spark)}/test-stage-{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == odd.columns
    assert {r["doc_id"] for r in docs.collect()} <= {4, 5} and seen[0] == 3 and seen[1] == 1


def plain_kept(text):
    """The quality rules with the bands' limits written out."""
    if plain_report(text)[5]:
        return False

    def ratio(part):
        return len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part)

    data = text.encode()
    whole = {200: (0.25, 0.85), 400: (0.25, 0.80), 600: (0.25, 0.77), 1_000: (0.22, 0.72), 2_000: (0.22, 0.68), 4_000: (0.20, 0.65), 32_000: (0.15, 0.62)}
    limits = [whole[size] for size in whole if size <= len(data)]
    parts = [data[k : k + 4096] for k in range(0, len(data) - 4095, 4096)] if len(data) > 4096 else []
    bad = sum(not 0.15 <= ratio(x) <= 0.65 for x in parts)
    return (not limits or limits[-1][0] <= ratio(data) <= limits[-1][1]) and 2 * bad <= len(parts)


def plain_contaminated(text, items):
    x = text.lower().split()
    return any(plain_distance(y, x[s : s + len(y)]) <= len(y) * 20 // 100 for y in items for s in range(len(x)))


def plain_mix(rows):
    """How often each of ``(doc_id, text, source)`` is taken."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain_words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ones, rest = {}, set(names), sum(sizes.values())
    while True:
        share = {s: weight[s] * rest / sum(weight[x] for x in open_ones) for s in open_ones}
        above = {s for s in open_ones if share[s] > 3 * sizes[s]}
        if not above:
            break
        target.update({s: 3 * sizes[s] for s in above})
        open_ones -= above
        rest -= sum(target[s] for s in above)
    target.update(share)

    def place(row):
        told = ":".join(["20"] + ["-" if v is None else f"={v}" for v in row[:2]])
        return int(hashlib.md5(told.encode()).hexdigest()[:15], 16)

    copies = Counter()
    for s in names:
        whole = int(target[s] // sizes[s])
        wanted, reached = target[s] - whole * sizes[s], 0
        for row in sorted((r for r in rows if r[2] == s), key=place):
            size = len(plain_words(row[1]))
            copies[row] += whole + (reached + size / 2 <= wanted)
            reached += size
    return copies, target, sizes


def plain_shards(shards, size):
    def slots(x):
        first, step = (int.from_bytes(hashlib.sha256(f"{salt}:{x}".encode()).digest()[:8], "big") for salt in ("first", "step"))
        return ((first % size + k * (step % (size - 1) + 1)) % size for k in range(size))

    owner, orders = {}, list(map(slots, shards))
    while len(owner) < size:
        for x, order in zip(shards, orders, strict=True):
            free = next((slot for slot in order if slot not in owner), None)
            if free is not None:
                owner[free] = x
    return owner


def test_pipeline_by_brute_force(spark, tmp_path):
    """The rows of a whole run from plain statements of its five stages."""
    rng = random.Random(31)
    items = [rng.choices(VOCABULARY, k=rng.randint(20, 40)) for _ in range(12)]
    rows = []
    for k in range(160):
        text = rng.choices(VOCABULARY, k=rng.randint(60, 160))
        source = rng.choice(["a", "a", "a", "a", "b", "\u00df", None])
        kind = k % 8
        if kind == 1:
            text = text[: rng.randint(0, 49)]
        elif kind == 2 and k > 8:
            text = rng.choice([r for r in rows if len(r[1].split()) >= 60])[1].split()
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(VOCABULARY)
        elif kind == 3:
            item = rng.choice(items)
            text[30:30] = edits(rng, item, rng.randint(0, len(item) // 10))
        elif kind == 4 and k % 16 == 4:
            text = [base64.b64encode(rng.randbytes(24)).decode() for _ in range(60)]
        elif kind == 5 and k % 16 == 5:
            text = text[:6] * 30
        rows.append((k, " ".join(text), source))
    rows += [rows[0], rows[0], (500, rows[8][1], "b"), (501, None, "a"), (502, "", None), (None, None, None)]
    docs = [(i, t, "en", s, len(t) if t else None) for i, t, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = [r for r in rows if plain_kept(r[1])]
    first = {i for i, _, component in brute_components([r[:2] for r in good], 5, 80) if i == component}
    single = sorted({r for r in good if r[0] in first}, key=lambda r: r[0])
    clean = [r for r in single if not plain_contaminated(r[1], items)]
    copies, target, sizes = plain_mix(clean)
    assert len(rows) > len(good) + 30 and len(good) > len(single) + 10 and len(single) > len(clean) + 10
    assert any(target[s] == 3 * sizes[s] for s in sizes) and any(copies[r] == 0 for r in clean)
    owner = plain_shards(queries.SHARDS, 65_537)
    expected = Counter()
    for (i, t, s), many in copies.items():
        seed = xxhash.xxh64(struct.pack("<i", 1), 42).intdigest()
        hashed = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(struct.pack("<q", i), seed).intdigest()))[0]
        expected[i, t, "en", s, len(t), hashed % 65_537, owner[hashed % 65_537]] += many
    found = corpus_pipeline.run(spark, str(tmp_path))
    got = Counter(map(tuple, found.select("doc_id", "text", "lang", "source", "n_chars", "slot", "shard").collect()))
    assert got == +expected


@pytest.mark.parametrize("one_task", [0, 1 << 22])
def test_components(spark, one_task):
    rng = random.Random(21)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = graph.components(spark.createDataFrame(edges, "u long, v long"), one_task).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in parent)
    assert graph.components(spark.createDataFrame([], "u long, v long"), one_task).count() == 0


def test_jaccard_of_a_large_group(spark):
    """Many near copies of one text, most of them farther from each other than links reach, and a common line."""
    rng = random.Random(22)
    base = [f"b{k}" for k in range(80)]
    line = " ".join(f"c{k}" for k in range(12))
    rows = []
    for k in range(260):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = f"own{rng.random()}"
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, line + " " + " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 6)))) for k in range(120)]
    got = {tuple(r) for r in jaccard.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), like=jaccard.Similarity(4, 85)).collect()}
    expected = brute_components(rows, 4, 85)
    assert got == expected
    assert 20 < len({c for i, _, c in expected if i < 1000}) < 240


def test_jaccard_moves_only_classes_in_pairs(spark, monkeypatch):
    """The rows of classes that stand in no pair, and all but a list's first five key bytes, are not shuffled."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(300)]
    rows += [(1000 + k, " ".join([f"own{rng.random()}", *(f"b{j}" for j in range(80))])) for k in range(4)]
    moved = []
    only = jaccard._only

    def seen(rows, key, wanted):
        kept = only(rows, key, wanted)
        moved.append((key, rows.count(), kept.count(), wanted.distinct().count()))
        return kept

    monkeypatch.setattr(jaccard, "_only", seen)
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    got = {tuple(r) for r in jaccard.near_duplicates(docs, like=jaccard.Similarity(4, 85)).collect()}
    assert got == brute_components(rows, 4, 85)
    classes = [x for x in moved if x[0] == "class"]
    assert classes and all(everyone == 304 and wanted <= kept < 60 for _, everyone, kept, wanted in classes)
    sets = jaccard.with_sets(docs.select("doc_id", "text"), jaccard.Similarity(4, 85), np.zeros(1 << jaccard.SKETCH_BITS, np.uint8))
    assert sets.select(F.explode("prefix").alias("t")).where("t & 16777215 != 0").isEmpty()


def test_jaccard_reads_short_lists_once(spark, monkeypatch):
    """Lists of few texts that share a line by chance are settled where they are sorted, and no link is lost."""
    rng = random.Random(5)
    rows = []
    for k in range(150):
        line = [f"l{k}x{j}" for j in range(12)]
        rows += [(10 * k + i, " ".join(line + [f"own{rng.random()}" for _ in range(60)])) for i in range(rng.choice((2, 3, jaccard._SHORT)))]
    for k in range(40):
        text = [f"t{k}x{j}" for j in range(100)]
        rows += [(5000 + 10 * k + i, " ".join([*text[:i], f"own{rng.random()}", *text[i:]])) for i in range(3)]
    again, mixed = [], jaccard._mixed

    def seen(*args):
        listed = mixed(*args)
        again.append(listed.groupBy("token").count().count())
        return listed

    monkeypatch.setattr(jaccard, "_mixed", seen)
    got = {tuple(r) for r in jaccard.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), like=jaccard.Similarity(4, 85)).collect()}
    assert got == brute_components(rows, 4, 85)
    assert again and max(again) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # only the first and last list of a task


def test_jaccard_pairs_of_a_group_that_many_tasks_hold(spark, monkeypatch):
    """Copies that link with one text and hardly with each other: pairs grow with the rows, also where tasks share a list."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(80)]
    rows = [(0, " ".join(base))]
    for k in range(1, 450):
        at = rng.randrange(5, 75)
        rows.append((k, " ".join([*base[:at], f"own{rng.random()}", *base[at + 1 :]])))
    compared, linked = [], jaccard._linked

    def seen(pairs, *args):
        compared.append(pairs.count())
        return linked(pairs, *args)

    monkeypatch.setattr(jaccard, "_linked", seen)
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {tuple(r) for r in jaccard.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), like=jaccard.Similarity(4, 85)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_components(rows, 4, 85)
    assert {c for _, _, c in got} == {0}
    assert sum(compared) <= 6 * len(rows)


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_jaccard_lists(step):
    """Long lists and a task's first and last one stay; short ones become all their pairs, however batches cut them."""
    lengths = [3, 1, 2, jaccard._SHORT, 1, jaccard._SHORT + 1, 2, 40, 1, 5, 2]
    token = np.repeat(np.arange(100, 100 + len(lengths)), lengths)
    columns = [token, np.arange(len(token)), np.full(len(token), 100, np.int32), np.zeros(len(token), np.int32)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], jaccard._POSTING[:4])
    batches = [whole.slice(at, step) for at in range(0, len(token), step)]
    got = pa.Table.from_batches(jaccard._in_lists(85)(iter(batches))).to_pylist()
    stay = [t for t, n in zip(range(100, 100 + len(lengths)), lengths, strict=True) if n > jaccard._SHORT or t in (100, 99 + len(lengths))]
    assert Counter(r["token"] for r in got if r["other"] is None) == Counter(int(t) for t in token if t in stay)
    pairs = {(int(a), int(b)) for t in set(token) - set(stay) for a in columns[1][token == t] for b in columns[1][token == t] if a < b}
    assert sorted((r["class"], r["other"]) for r in got if r["other"] is not None) == sorted(pairs)


def test_pipeline_hands_texts_over_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for rows, after in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            spark.conf.set(key, rows)
            corpus_pipeline.rules(spark, frame(spark, [(1, "a b", "s")]), "")
            assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, before)
