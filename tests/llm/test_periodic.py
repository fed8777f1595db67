"""Lyndon arrays and runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from harrow.llm import periodic
from harrow.llm.periodic import digests, kept_words, lyndon_array, periodic_runs, runs_of, with_periodic_ends
from tests.conftest import rows


def longest_lyndon(s):
    """By the definition of Duval's step, from each place anew."""
    out = []
    for i in range(len(s)):
        j, k = i + 1, i
        while j < len(s) and s[k] <= s[j]:
            k = i if s[k] < s[j] else k + 1
            j += 1
        out.append(j - k)
    return out


def all_runs(s, length=6, periods=4):
    found = []
    for q in range(1, len(s) // periods + 1):
        i = 0
        while i + q < len(s):
            begin = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            size = i - begin + q
            part = s[begin:begin + size]
            if size >= max(length, periods * q) and not any(
                    all(part[x] == part[x + d] for x in range(size - d)) for d in range(1, q)):
                found.append((begin, size, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(n):
    r = random.Random(3)
    for _ in range(n):
        k = r.choice([1, 2, 2, 3, 4, 8])
        s = [r.randrange(k) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5:
            root, at = [r.randrange(k) for _ in range(r.randint(1, 6))], r.randint(0, len(s))
            s = s[:at] + (root * 20)[:r.randint(4, 40)] + s[at:]
        yield s


def test_lyndon_array():
    for s in sequences(800):
        assert lyndon_array(np.array(s, dtype=np.int64)).tolist() == longest_lyndon(s), s


@pytest.mark.parametrize("length, periods", [(6, 4), (2, 2), (6, 3), (1, 5)])
def test_runs(length, periods):
    for s in sequences(800):
        assert runs_of(np.array(s, dtype=np.int64), length, periods) == all_runs(s, length, periods), s


def test_narrowing_in_any_number_of_rounds(monkeypatch):
    for rounds in (1, 2):
        monkeypatch.setattr(periodic, "NARROWINGS", rounds)
        for s in sequences(200):
            assert runs_of(np.array(s, dtype=np.int64)) == all_runs(s)


def test_long_repetitions():
    assert runs_of(np.zeros(50_000, dtype=np.int64)) == [(0, 50_000, 1)]
    assert runs_of(np.tile(np.arange(7), 9000)) == [(0, 63_000, 7)]
    base = np.arange(20_000)
    assert runs_of(np.r_[base, np.tile(base[:5000], 4)])[-1] == (20_000, 20_000, 5000)
    with pytest.raises(ValueError):
        runs_of(base, 6, 1)


def expected(doc_id, text, change=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if change and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    numbers = {}
    runs = all_runs([numbers.setdefault(w, len(numbers)) for w in words])
    dropped = {i for b, size, q in runs for i in range(b + q, b + size)}
    best = (None,) * 4
    if runs:
        b, size, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = b, size, q, 1000 * size // q
    lines = "".join(f"{b},{size},{q}\n" for b, size, q in runs)
    text = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_query_form_against_brute_force(spark):
    r = random.Random(4)
    words = ["a", "b", "c", "Word", "ü", "x y"]
    texts = [None, "", " ", "\n\t \x0b\x0c\r", "a", "a a a a a a", "a\x0ba a\ta a  a a"]
    texts += [r.choice([" ", "\n", "  "]).join(r.choice(words) for _ in range(r.randint(1, 50))) for _ in range(150)]
    texts += [" ".join(["one", "two", "three"] * 40 + ["end"]), "long " * 3000]
    data = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, "a a a a a a b", 0, "x"), (5, texts[5], 5, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs int, period string")
    key = (lambda rs: sorted(rs, key=lambda r: tuple((v is not None, v) for v in r)))
    assert rows(digests(periodic_runs(docs))) == key(expected(d, t, False) for d, t, *_ in data)
    assert rows(digests(periodic_runs(with_periodic_ends(docs)))) == key(expected(d, t) for d, t, *_ in data)
    assert digests(periodic_runs(with_periodic_ends(docs.limit(0)))).collect() == []


def test_first_run_wins_ties_and_repetitions_go(spark):
    docs = spark.createDataFrame([(1, "b b b b b b x c d c d c d c d c d c d y")], "doc_id long, text string")
    found = periodic_runs(docs).first()
    assert [tuple(r) for r in found.runs] == [(0, 6, 1), (7, 12, 2)]
    assert found.collapsed == "b x c d y"
    assert digests(periodic_runs(docs)).select("start", "exponent_milli").first() == (0, 6000)
    assert kept_words(3, []).all()
