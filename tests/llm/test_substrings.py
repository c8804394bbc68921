import hashlib

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def brute(docs, length):
    seen, out = set(), {}
    for i, t in docs:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest())
    return out


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_substring_dedup(spark, SF).collect()}
    assert got == brute(docs, 100)


def digest(df):
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", "n_bytes", n, F.size("spans"), F.coalesce(F.sha2("kept", 256), "sha256")).collect()}


def test_edges_hot_anchors_and_odd_rows(make_docs, prose, odd_texts):
    rows = list(enumerate(odd_texts))
    shared = prose(40, 20)
    for k in range(30):
        rows.append((100 + k, prose(k, 700 + k) + shared[k % 9 : 150 + k] + "é" * (k % 5) + prose(9, 800 + k)))
    rows.append((200, "ab" * 300))
    docs = make_docs(rows)
    assert digest(substrings.remove_repeats(docs)) == brute(rows, 100)
    assert digest(substrings.remove_repeats(docs, length=40, bucket_bytes=2000)) == brute(rows, 40)
    assert digest(substrings.remove_repeats(docs, length=40, hot_rows=3)) == brute(rows, 40)


def test_repeated_ids(make_docs, prose):
    t = prose(60, 5)
    docs = make_docs([(1, t), (1, t), (2, t + " end"), (None, prose(20, 6))])
    got = [(r.doc_id, len(r.spans)) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (2, 1), (None, 0)], key=str)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_order():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    starts = np.arange(len(data) - 4)
    order, _ = substrings.suffix_order(data, starts, 8 if len(data) > 100 else 8)
    key = lambda k: bytes(data[k : k + 8]).ljust(8, b"\0")
    assert order.tolist() == sorted(starts.tolist(), key=lambda k: (key(k), k))
