"""Each stage of the pipeline against a plain version, and all of them in a row."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.llm import lines

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, taken long, n_lines long, size string"


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(21)
    vocab = ["".join(r.choices("abcdeiou", k=r.randint(2, 7))) for _ in range(500)]
    text = lambda n: "\n".join(" ".join(r.choices(vocab, k=15)) for _ in range(n // 15))
    out = [None, "", " \n", "few words", "same " * 300, text(120), "x" * 5000]
    shared = text(30)
    for k in range(24):
        base = text(r.choice([75, 150, 300]))
        out.append(base)
        if k % 3 == 0:
            out.append(base)  # an exact copy
        if k % 3 == 1:
            w = base.split(" ")
            for i in r.sample(range(len(w)), 3):
                w[i] = "zz"
            out.append(" ".join(w))
        if k % 4 == 2:
            out.append(text(75) + "\n" + shared)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 7 == 0 else f"s{i % 3}", len(t or ""), True, 9, 9, "s") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(texts):
    rows = list(enumerate(texts))
    return [*rows, rows[8], rows[8], (None, texts[9] + " and some more words here"), (None, None)]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    table(spark, rows).select(*pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 2), 0) for i, _ in rows[:40] if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def content(df):
    assert df.columns == pipeline.COLUMNS
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_quality(spark, rows, sf):
    from granula.llm import quality

    def passes(text):
        w = words(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {x for x, n in collections.Counter(windows).items() if n > 1}
        return len(w) >= 50 and 100 * len({i + d for i, x in enumerate(windows) if x in often for d in range(3)}) <= 50 * len(w)

    got = content(pipeline.quality_rules(spark, table(spark, rows), sf))
    verdict = {(r.doc_id, r.n_words): r.kept for r in quality.quality(table(spark, rows), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert got == collections.Counter((i, t) for i, t in rows if passes(t) and verdict[i, len(words(t))])
    assert got and all(passes(t) for _, t in got)


def test_line_dedup(spark, rows, sf):
    order = sorted(dict.fromkeys(rows), key=lambda x: (x[0] is None, x[0] or 0))
    where = [(i, t, k, x) for i, t in order for k, x in enumerate((t or "").split("\n")) if x.encode().split()]
    distinct = list(dict.fromkeys(x for *_, x in where))
    up = {x: x for x in distinct}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if lines.similar(a.encode(), b.encode(), 85):
            up[find(b)] = find(a)
    seen, gone = set(), collections.defaultdict(set)
    for i, t, k, x in where:
        if find(x) in seen:
            gone[i, t].add(k)
        seen.add(find(x))
    want = collections.Counter()
    for i, t in rows:
        parts = (t or "").split("\n")
        left = [x for k, x in enumerate(parts) if k not in gone[i, t]]
        if not gone[i, t] or any(x.encode().split() for x in left):
            want[i, t if not gone[i, t] else "\n".join(left)] += 1
    assert content(pipeline.line_dedup(spark, table(spark, rows), sf)) == want


def test_near_dedup(spark, rows, sf):
    known = dict(x for x in rows if x[0] is not None)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in known.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = collections.Counter((i, t) for i, t in known.items() if find(i) == i) + collections.Counter(x for x in rows if x[0] is None)
    assert content(pipeline.near_dedup(spark, table(spark, rows), sf)) == want
    assert sum(find(i) != i for i in up) > 10


def test_mix(spark, rows, sf):
    from granula.llm import common, mixing

    docs = table(spark, rows)
    taken = collections.Counter()
    size = {}
    for r in mixing.mix(docs.select(*pipeline.COLUMNS), common.word_count(F.col("text"))).collect():
        taken[r.doc_id, r.text] += r.taken
        size[r.doc_id, r.text] = r.size
    got, pieces = collections.Counter(), collections.Counter()
    for r in pipeline.mix_sources(spark, docs, sf).collect():
        whole = [t for i, t in size if i == r.doc_id and words(t)[: len(words(r.text))] == words(r.text)]
        assert whole and r.n_chars == len(r.text) or r.text in {t for _, t in size}
        got[r.doc_id, whole[0]] += len(words(r.text))
        pieces[r.doc_id, r.text] += r.text not in {t for _, t in size}
    assert got == collections.Counter({k: n for k, n in taken.items() if n})
    assert sum(pieces.values()) > 0


def test_pack(spark, rows, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    once = [x for x in rows if x[0] is not None and rows.count(x) == 1]
    got = collections.defaultdict(list)
    for r in pipeline.pack(spark, table(spark, once), sf).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, text in once:
        whole, at = ids(text), 0
        for start, length, crc, total in sorted(got[i]):
            assert start == at and total == len(whole) and crc == zlib.crc32(whole[start : start + length].tobytes())
            at += length
        assert at == len(whole)


def test_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    want = docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    got = pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_empty_documents(spark, sf):
    none = table(spark, []).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
