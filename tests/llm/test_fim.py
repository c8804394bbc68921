import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from factloom.llm import fim, queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(i, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return i, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_whole_table_and_twin(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13_fill_in_middle(spark, SF).collect()))
    assert got == sorted((*brute(i, t)[:5], sha(brute(i, t)[5]), sha(t or "")) for i, t in docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(fim.ORACLE).fetchall())


def odd(odd_texts):
    texts = [*odd_texts, "\n", "\n\n\n", "a\n\nb", "no end", "end\n", "<P> inside\nline", "x<S>", "é\n😀\nü" * 50, "<\n<P\nS>\n>M", "\r\n a \r b\n"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (3, "another\ntext\n"), (None, "null\nid\n"), (None, None)]
    return rows + [(1000 + k, "l1\nl2\n<\nP>\nl5") for k in range(30)]


def test_defined_cases_whole_texts(make_docs, odd_texts):
    rows = odd(odd_texts)
    got = fim.transformed(fim.output_pieces(make_docs(rows))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    back = sorted(map(tuple, fim.digests(make_docs(rows)).collect()), key=repr)
    assert back == sorted(((*brute(i, t)[:5], sha(brute(i, t)[5]), sha(t or "")) for i, t in rows), key=repr)
    assert fim.digests(make_docs(rows).limit(0)).count() == 0


def test_small_pieces_stay_whole_characters_and_lines(make_docs, odd_texts):
    rows = odd(odd_texts)
    pieces = fim.output_pieces(make_docs(rows), size=8, rate=70, spm=30)
    texts = pieces.select("piece").collect()
    assert all(len(bytes(r.piece)) <= 8 + 3 and bytes(r.piece).decode() is not None for r in texts)
    got = sorted(map(tuple, fim.transformed(pieces).collect()), key=repr)
    assert got == sorted((brute(*r, rate=70, spm=30) for r in rows), key=repr)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    back = fim.digests(make_docs(rows), size=8, rate=70, spm=30)
    assert back.where(F.col("form") != "plain").count() > 10
    assert sorted(r.restored_sha256 for r in back.collect()) == sorted(sha(t or "") for _, t in rows)


def test_one_shuffle(make_docs):
    plan = fim.digests(make_docs([(1, "a\nb\n")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
