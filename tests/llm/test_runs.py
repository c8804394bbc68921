import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words, least, times):
    """Every run, by looking at each period and each stretch of equal words at that distance."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length = k, end + q - k
            stretch = words[start : start + length]
            if length >= max(least, times * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((start, length, q))
            k = end
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4), st.integers(6, 12), st.integers(2, 4))
def test_random_words(seed, letters, least, times):
    r = random.Random(seed)
    words = []
    while len(words) < 120:
        piece = [b"%d" % r.randrange(letters) for _ in range(r.randrange(1, 9))]
        words += piece * r.choice([1, 1, 2, 4, 7])
    assert runs.runs_of(words, least, times) == brute(words, least, times)


def test_long_words_and_nested_periods():
    inner = [b"a", b"b"] * 20 + [b"c"]
    assert runs.runs_of(inner * 5) == brute(inner * 5, 24, 3)
    one = [b"x"] * 50_000
    assert runs.runs_of(one) == [(0, 50_000, 1)]
    r = random.Random(3)
    period = [b"%d" % r.randrange(10**6) for _ in range(20_000)]
    tail = [b"p", b"q"] + period * 3 + period[:7] + [b"end"]
    assert runs.runs_of(tail) == [(2, 60_007, 20_000)]
    assert runs.runs_of(period) == []


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = planted(d.doc_id, re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        found = brute([numbers[w] for w in words], 24, 3) if len(words) < 1500 else runs.runs_of([w.encode() for w in words])
        drop = {k for s, n, q in found for k in range(s + q, s + n)}
        r = got[d.doc_id]
        assert r.n_runs == len(found)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in drop).encode()).hexdigest()
        some += bool(found)
    assert some >= 10


def test_defined_cases(make_docs, odd_texts):
    rows = list(enumerate(odd_texts)) + [(None, "a b " * 30), (7, "a b " * 30), (7, "a b " * 30)]
    got = runs.periodic_runs(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [r.asDict() for r in by[7].runs] == [{"start": 0, "length": 60, "period": 2}] and by[7].collapsed == "a b" == by[None].collapsed
    assert by[6].runs[0].asDict() == {"start": 0, "length": 40, "period": 1} and by[6].collapsed == "same"
    assert (by[0].runs, by[0].strongest, by[0].collapsed) == ([], None, "") and by[1].collapsed == "" and by[5].collapsed == odd_texts[5]
    assert runs.periodic_runs(make_docs(rows).limit(0)).count() == 0


def test_ties(make_docs):
    text = " ".join(["a b"] * 15 + ["x"] + ["c d"] * 15)
    r = runs.periodic_runs(make_docs([(1, text)])).first()
    assert len(r.runs) == 2 and r.strongest.start == 0


@pytest.mark.parametrize("least,times", [(24, 3), (10, 2), (9, 3)])
def test_every_rotation_at_the_border(least, times):
    for q in range(1, 12):
        for extra in range(-2, 3):
            n = max(least, times * q) + extra
            words = [b"l"] + [b"%d" % (k % q) for k in range(n)] + [b"r"]
            assert runs.runs_of(words, least, times) == brute(words, least, times)
