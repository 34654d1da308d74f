"""Periodic runs and tokenizer alignment against plain versions."""

import collections
import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from granula.llm import runs, tokenizer_alignment

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, words string, starts string, block long, pair long, n long, known string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "w", "s", 1, 2, 3, "k") for i, t in rows], SCHEMA).repartition(parts)


def plain_runs(w):
    """All runs by trying every period at every place."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        alike = "".join("1" if w[i] == w[i + q] else "0" for i in range(len(w) - q))
        at = 0
        for same, group in itertools.groupby(alike):
            n = len(list(group))
            if same == "1" and n + q >= max(6, 4 * q) and not any(w[at : at + n + q - p] == w[at + p : at + n + q] for p in range(1, q)):
                out.append((at, n + q, q))
            at += n
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(400):
        n, k = r.randint(0, 70), r.choice([1, 2, 3, 6])
        w = [r.randrange(k) for _ in range(n)]
        if n > 8 and r.random() < 0.7:
            p, a = r.randint(1, n // 4), r.randrange(n)
            for i in range(a, min(n, a + r.randint(4, 7) * p)):
                w[i] = w[a + (i - a) % p]
        assert [*zip(*(x.tolist() for x in runs.find_runs(np.array(w, np.int64))), strict=True)] == plain_runs(w)


def test_wavelet_tree():
    r = np.random.default_rng(2)
    v = r.permutation(300).astype(np.int64)
    tree = runs.WaveletTree(v, 9)
    lo = r.integers(0, 299, 200)
    hi = r.integers(lo + 1, 301)
    x, k = r.integers(0, 300, 200), r.integers(0, hi - lo)
    assert tree.below(lo, hi, x).tolist() == [(v[a:b] < c).sum() for a, b, c in zip(lo, hi, x, strict=True)]
    assert tree.ranked(lo, hi, k).tolist() == [np.sort(v[a:b])[c] for a, b, c in zip(lo, hi, k, strict=True)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    some = [None, "", " \n\t ", "a", "a a a a a a", "a b " * 9, "a\tb\x0ba b\na b a b\xa0a b", "x" * 5000, "é " * 12 + "ß ß ß ß ß ß ß"]
    for _ in range(120):
        w = [r.choice("abcdefghij") for _ in range(r.randint(1, 90))]
        some.append(" ".join(w))
    some += [" ".join(r.choices("ab", k=3000)), "one two three " * 4000]
    rows = list(enumerate(some))
    return [*rows, rows[5], rows[5], (None, "a a a a a a a"), (None, None)]


def test_periodic_runs(spark, texts):
    got = collections.Counter(tuple(r) for r in runs.digest(runs.periodic_runs(table(spark, texts), plant=True)).collect())
    want = collections.Counter()
    for doc, text in texts:
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, len(w)))]
        found = plain_runs(w) if len(w) < 5000 else [(0, len(w), 3)]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        want[(doc, len(found), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())] += 1
    assert got == want
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, t in texts if d is not None and t) > 3


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    assert runs.digest(runs.periodic_runs(none)).count() == 0
    assert tokenizer_alignment.link_counts(none, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0
    assert tokenizer_alignment.align(none, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0


def test_alignment(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    latin = [c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]]
    odd = [x for x in range(256) if x not in latin]
    byte = {chr(c): c for c in latin} | {chr(256 + k): c for k, c in enumerate(odd)}
    r = random.Random(6)
    some = [None, "", " ", "a", "<|endoftext|> a <s>", "  two  gaps\n\n", "a▁b", "x" * 20_000, "same words " * 3000]
    some += ["".join(r.choices("aBé ßΣ'.,!%_-<|>1½\n\t  中。̇🎉", k=r.randint(1, 40))) for _ in range(300)]
    some += [" ".join("".join(r.choices("abcdehinorst", k=r.randint(1, 9))) for _ in range(60)) for _ in range(60)]
    rows = [*enumerate(some), (3, "a"), (3, "a"), (None, "some text"), (None, None)]
    plain, links = [], []
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        bytes_b = [bytes.fromhex(t[3:5]) if b.is_byte(i) else t.replace("▁", " ").encode() for i, t in zip(y, map(b.id_to_piece, y), strict=True)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            plain.append((doc, 0, 0, "", []))
            continue
        ends_a, ends_b = ([*itertools.accumulate(map(len, s))] for s in (bytes_a, bytes_b))
        at_a, at_b = ({e: k for k, e in enumerate(ends)} for ends in (ends_a, ends_b))
        shared, told, mine, p, q = sorted(at_a.keys() & at_b.keys()), [], [], 0, 0
        for e in shared:
            i, j = at_a[e] + 1, at_b[e] + 1
            told.append(",".join(map(str, x[p:i])) + "|" + ",".join(map(str, y[q:j])))
            mine.append((x[i - 1], y[j - 1]))
            p, q = i, j
        links += mine
        plain.append((doc, len(x), len(y), ";".join(told), mine))
    count = collections.Counter(links)
    top = collections.defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    digest = lambda told: hashlib.sha256(told.encode()).hexdigest() if told else ""
    want = collections.Counter((d, x, y, len(m), len(m), sum(count[l] == top[l[1]] for l in m), sum(count[l] for l in m), digest(told)) for d, x, y, told, m in plain)
    docs = table(spark, rows)
    for size in (1 << 23, 300):
        assert collections.Counter(tuple(x) for x in tokenizer_alignment.link_counts(docs, a_path, b_path, block_bytes=size).collect()) == want
    got = collections.Counter((x.doc_id, x.n_a, x.n_b, x.groups, tuple(x.links)) for x in tokenizer_alignment.align(docs, a_path, b_path).collect())
    assert got == collections.Counter((d, x, y, told, tuple(i * tokenizer_alignment.PAIR + j for i, j in m)) for d, x, y, told, m in plain)
