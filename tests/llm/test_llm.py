"""Operators against plain versions on a small table with nulls, blanks, ties, copies and clashing columns."""

import collections
import hashlib
import io
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.llm import common, components, lines, mixing, near_duplicates, packing, quality, sharding, substrings, token_files, tokens, topk, warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, size string, passes string, key string, n long"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdeiou", k=r.randint(2, 7))) for _ in range(400)]
    text = lambda n: "\n".join(" ".join(r.choices(vocab, k=12)) for _ in range(n // 12))
    out = [None, "", " \n\t", "one", "a b c", "A B c", text(240), "x" * 30_000, "same " * 300, "é ß z ", "<|endoftext|> a", "  two  gaps\n\n"]
    base = [text(r.choice([60, 120, 600])) for _ in range(25)]
    passage = text(48)
    for b in base:
        out += [b, b] if r.random() < 0.4 else [b]
        w = b.split(" ")
        for n in (1, 3, 12):
            v = list(w)
            for i in r.sample(range(len(v)), min(n, len(v))):
                v[i] = r.choice(vocab)
            out.append(" ".join(v) + (" " + passage if n == 3 else ""))
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, "k", "s", "p", "y", 1) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def components_of(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_substrings(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(substrings.remove_repeats(docs)).collect()}
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, t, *_ in rows:
        w = words(t)
        gone = {s + j for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, s) for j in range(20)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        assert got[i] == (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()), i


def test_near_duplicates(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words((t or "").lower() if (t or "").isascii() else t)) else set() for i, t, *_ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = components_of(sets, pairs)
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_near_duplicates_in_a_large_family(spark):
    r = random.Random(11)
    word = lambda: f"w{r.getrandbits(60):x}"
    base = [word() for _ in range(404)]
    texts = []
    for _ in range(150):  # partners at 0.75 and more in a family at about 0.7
        shared = [word() for _ in range(18)]
        texts += [" ".join(base + shared + [word() for _ in range(68)]) for _ in range(2)]
    order = r.sample(range(300), 300)
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string")).collect()}
    sets = {}
    for i, k in enumerate(order):
        w = texts[k].split()
        sets[i] = {tuple(w[s : s + 5]) for s in range(len(w) - 4)}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(pairs) == 150 and got == components_of(sets, pairs)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    x = np.sort(r.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b, u = near_duplicates.registers([x[:2000], x[1000:], x])
    assert (near_duplicates.merge(a, b) == u).all()
    assert abs((a == b).mean() - 1 / 3) < 0.15
    assert not near_duplicates.plausible(a[None], b[None], np.array([2000]), np.array([2000]), 0.75)[0]


def test_lines(docs, rows):
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.dedup_lines(docs).collect()}
    where = [(i, k, x) for i, t, *_ in rows for k, x in enumerate((t or "").encode().split(b"\n")) if x.split()]
    distinct = list(dict.fromkeys(x for *_, x in where))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(distinct)), 2) if lines.similar(distinct[a], distinct[b], 85)]
    label = components_of(range(len(distinct)), pairs)
    seen, gone, total = set(), collections.Counter(), collections.Counter()
    number = {x: n for n, x in enumerate(distinct)}
    for i, _, x in where:
        total[i] += 1
        gone[i] += label[number[x]] in seen
        seen.add(label[number[x]])
    assert got == {i: (total[i], gone[i]) for i, *_ in rows}


def test_lines_in_a_large_family(spark):
    r = random.Random(5)
    chars = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    base, rows = chars(800), []
    for _ in range(200):  # partners at about 0.9 in a family at about 0.7
        shared = chars(130)
        rows += [base + shared + chars(50) for _ in range(2)]
    r.shuffle(rows)
    got = {x.doc_id: x.n_removed for x in lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    sets = [lines.shingle_set(x.encode()) for x in rows]
    keys = [set(k) for k in lines.signatures([x.encode() for x in rows]).tolist()]
    pairs = [(a, b) for a, b in itertools.combinations(range(400), 2) if keys[a] & keys[b] and 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    label = components_of(range(400), pairs)
    assert len(pairs) > 190 and got == {i: int(label[i] != i) for i in range(400)}


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs, path).collect():
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text, *_ in rows:
        assert [x for _, p in sorted(got[i]) for x in p] == [*t.encode(text or "", add_special_tokens=False).ids, 1]
    for s in sequences.values():
        s.sort()
        assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(s)) and s[0][0] == 0
        total = sum(n for _, n in s)
        assert total & (total - 1) == 0 and total <= 2048


def test_sum_of_squares_places_by_cost():
    p = packing.SumOfSquares(8)
    assert p.put("a", 3) is None and p.levels[3] == 1
    assert p.put("b", 5) == ["a", "b"] and not p.levels.any()


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    path, out = P.path("word_bpe_49k.json"), common.shared_dir(spark, "t")
    token_files.write(docs, out, path)
    t = Tokenizer.from_file(path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(token_files.read(spark, out)).collect()}
    start = 0
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "é"), (4, "u", "é"), (5, "u", "b" * 100_000)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: (0, "revisit", 2), 2: (0, "response", None), 3: (2, "revisit", 4), 4: (2, "response", None), 5: (100_000, "response", None)}
    data = b"".join(warc.record(f"urn:page:{i}", "u", os.urandom(i * 9) + warc.MAGIC, "X", None, "d") for i in range(200))
    for step in (50, 777, 10**6):
        found = [at for s in range(0, len(data), step) for at, _ in warc.members(io.BytesIO(data), s, s + step, len(data))]
        assert len(found) == len(set(found)) == 200


def test_topk(spark):
    r = np.random.default_rng(5)
    x = r.integers(-3, 4, (300, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)]
    v = spark.createDataFrame(rows, "id long, v array<long>")
    got = sorted(tuple(r) for r in topk.search(v, v.where("id % 50 = 0"), 5, shard_rows=70).collect())
    s = x @ x.T
    want = [(q, k + 1, j, int(s[q, j])) for q in range(0, 300, 50) for k, j in enumerate([j for j in np.lexsort((np.arange(300), -s[q])) if j != q][:5])]
    assert got == sorted(want)


def test_mixing(docs, rows):
    run = lambda d: {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(d, common.word_count(F.col("text")), shard_size=500).collect()}
    got = run(docs)
    assert got == run(docs.repartition(7))
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for i, t, _, s, *_ in rows:
        assert got[i][0] == len(words(t)) and 0 <= got[i][3] <= 2 * got[i][0]
        size[s] += got[i][0]
        taken[s] += got[i][3]
        target[s] = got[i][2]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) < 0.05 * target[s] + 16


def test_sainte_lague_is_the_divisor_method(spark):
    votes = [53, 24, 23, 7, 1]
    parts = spark.createDataFrame(list(enumerate(votes)), "id long, votes long")
    for seats in (1, 7, 40):
        want = [0] * 5
        for _ in range(seats):
            want[max(range(5), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        got = {r.id: r.quota for r in mixing.sainte_lague(parts, [], F.lit(seats), F.col("votes"), F.col("id")).collect()}
        assert [got[i] for i in range(5)] == want


def test_sharding(spark):
    rows = spark.range(3000).selectExpr("id", "id % 90 AS b").unionByName(spark.createDataFrame([(7777, 50_000)], "id long, b long"))
    out = sharding.shard(rows, "id", F.col("b"), 2000).groupBy("shard_depth", "shard_prefix").agg(F.sum("b").alias("b"), F.max("shard_bytes").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in out) == 3001 and all(r.b == r.s for r in out)
    assert [r.n for r in out if r.b > 2000] == [1]


def test_quality_counts_and_held_out_accuracy(spark, rows, docs):
    for _, t, *_ in rows:
        w = words(t)
        n = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {i + d for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for d in range(3)}
        ls = [x for x in (t or "").encode().split(b"\n") if x.split()]
        assert quality.base_counts((t or "").encode())[0::3][0] == len(w)
        assert quality.base_counts((t or "").encode())[3:] == (len(ls) - len(set(ls)), len(cover))
    sf = "/root/testdata/sf0.01"
    if os.path.isdir(sf):
        d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
        kept = quality.quality(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1 and toxic = 0"), "doc_id").where("not base_failed")
        right = kept.agg(F.avg(F.when(F.col("kept") == (F.col("quality") == 1), 1.0).otherwise(0.0))).first()[0]
        assert right > 0.95


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (8, 7), (7, 7), (10, 8), (None, 1)], "a long, b long")
    assert {r.id: r.component for r in components.components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7, 10: 7}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (
        lambda: substrings.remove_repeats(none), lambda: near_duplicates.near_duplicates(none), lambda: lines.dedup_lines(none), lambda: quality.quality(none, labels),
        lambda: packing.pack(none, P.path("byte_bpe_50k.json")), lambda: mixing.mix(none, common.word_count(F.col("text"))), lambda: sharding.shard(none, "doc_id", F.octet_length("text"), 9),
    ):
        assert f().count() == 0


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize(("name", "lossy"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_library(name, lossy, plain):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(name))
    if plain:
        library.encode_special_tokens = True
    r = random.Random(7)
    letters = "aBé ßΣς'.,!%_-<|>1२½\n\t ʼńİǅ中。\u0307"
    texts = ["".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(4000)]
    texts += ["don't.", "x's!!", "'s.'", "a_b__", "it's.&&&", "we'll'll", "é.,", "İ'", "İ!%", "be%%% be%%%", "<|endoftext|>!"]
    parts = ["a", " b", "<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "!!", "\n", " ", "é.", "<|"]
    texts += ["".join(r.choices(parts, k=r.randint(1, 7))) for _ in range(3000)]
    encode = tokens.Encoder(P.path(name), lossy, most=500, plain=plain)
    for k in range(0, len(texts), 200):
        some = texts[k : k + 200]
        whole = library.encode_batch_fast(some, add_special_tokens=False)
        assert encode(some) == [np.array(x.ids, "<u4").tobytes() for x in whole]


def test_signatures_in_parts():
    found = [bytes([65 + i % 26]) * (1 + i * 37 % 3000) for i in range(300)]
    whole = lines.signatures(found, 1 << 30)
    assert all((lines.signatures(found, most) == whole).all() for most in (1, 500, 1 << 16))


def test_texts_are_not_sorted_for_their_lines(spark):
    text = "a line that comes twice\n \x0b\t\n\xa0\nA line that comes twice\na line that comes twice\n"
    out = lines.dedup_lines(spark.createDataFrame([(1, text), (2, None), (3, " \x0c ")], "doc_id long, text string"))
    assert {r.doc_id: r.n_lines for r in out.collect()} == {1: 4, 2: 0, 3: 0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    joined = [x for x in plan.splitlines() if "Join [__k#" in x]
    assert joined and all("ShuffledHashJoin" in x for x in joined)
