import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import attribution, queries, rangecoder, tokenout

SF = "/root/testdata/sf0.001"

ids = st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 65535), st.integers(0, (1 << 32) - 1)), max_size=60), max_size=12)


@settings(max_examples=40, deadline=None)
@given(ids)
def test_round_trip(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    assert [b.tolist() for b in rangecoder.decode_blocks(rangecoder.encode_blocks(blocks))] == [b.tolist() for b in blocks]


@pytest.mark.parametrize("n", [255, 256, 511, 512, 5000, 32_767, 65_535, 65_536])
def test_round_trip_of_large_blocks(n):
    r = np.random.default_rng(n)
    blocks = [r.integers(0, top, n) for top in (1, 2, 300, 49_408, 1 << 20, 1 << 32)] + [np.arange(n), np.full(n, (1 << 32) - 1), np.minimum(r.zipf(1.3, n), 49_407)]
    coded = rangecoder.encode_blocks(blocks)
    assert coded[2] == rangecoder.encode_blocks([blocks[2]])[0]  # a block does not depend on those beside it
    assert [(a == b).all() and len(a) == n for a, b in zip(rangecoder.decode_blocks(coded), blocks)] == [True] * len(blocks)


def test_long_blocks_are_refused():
    with pytest.raises(ValueError, match="at most"):
        rangecoder.encode_blocks([np.zeros(rangecoder.BLOCK + 1, np.int64)])


def test_order_two_text_shrinks_and_damage_shows():
    block = np.tile(np.arange(7, 40000, 997, dtype=np.int32), 40)
    coded = rangecoder.encode_blocks([block])[0]
    assert len(coded) < len(block) / 4  # under 2 bits an id where 16 are plain
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.decode_blocks([coded[:-1] + bytes([coded[-1] ^ 1])])
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.decode_blocks([b"nope"])


def test_fewer_bits_than_zlib_and_order_zero():
    tok = tokenout.WordTokenizer(queries.TOKENIZER)
    x, _ = tok.encode(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist(), 1)
    coded = rangecoder.encode_blocks([x[k : k + rangecoder.BLOCK] for k in range(0, len(x), rangecoder.BLOCK)])
    p = np.bincount(x) / len(x)
    p = p[p > 0]
    bits = sum(map(len, coded)) * 8 / len(x)
    assert bits < -(p * np.log2(p)).sum() < len(zlib.compress(x.astype("<u2").tobytes())) * 8 / len(x)


def test_pieces_outlast_forgotten_words():
    tok = tokenout.WordTokenizer(queries.TOKENIZER, most_words=60)
    plain = Tokenizer.from_file(queries.TOKENIZER)
    ends = [f"{a}{b}" for a in ("", "(", '"', "#", "--") for b in ("", ".", ",", ")", "!", "?")]
    words = [f"{e}quorvel{e}" for e in ends] + [f"{e}tarnish{e}" for e in ends]  # sixty words of two stems
    first, later = (tok.encode([" ".join(w)], 1)[0].tolist() for w in (words[:50], words[50:]))
    assert (first, later) == tuple([*plain.encode(" ".join(w), add_special_tokens=False).ids, 1] for w in (words[:50], words[50:]))
    tok.encode([" ".join(f"tarnish{k}" for k in range(50))], 1)  # more words than the table holds
    assert len(tok.known) < 60 and "quorvel" in tok.pieces.to_pylist()


def test_steps_of_little_mass_take_two_words():
    r = np.random.default_rng(5)
    blocks = [np.where(r.random(60_000) < 0.999, 7, r.integers(0, top, 60_000)) for top in (9, 49_408, 1 << 32)]  # what is foretold wrongly has one part in 2^28 at least
    for b, d in zip(blocks, rangecoder.decode_blocks(rangecoder.encode_blocks(blocks))):
        assert (b == d).all()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="white space"):
        tokenout.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def expect(docs):
    tok, start, out = Tokenizer.from_file(queries.TOKENIZER), 0, []
    for i, t in docs:
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    return out


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(map(tuple, queries.op1_token_ids(spark, SF).collect())) == expect(docs)


def test_odd_rows(make_docs, odd_texts):
    rows = [(k, t) for k, t in enumerate([*odd_texts, "a<|endoftext|>b it's I'm 12\x1c3 x", "ΑΣ ΟΔΟΣ İ ﬁ"])]
    got = tokenout.token_digests(make_docs([*rows[5:], *rows[:5]]), queries.TOKENIZER)
    assert sorted(map(tuple, got.collect())) == expect(rows)
    twice = tokenout.token_digests(make_docs([(1, "x"), (1, "x"), (None, "y")]), queries.TOKENIZER).orderBy("start").collect()
    assert [r.doc_id for r in twice] == [None, 1, 1]
    assert tokenout.token_digests(make_docs(rows).limit(0), queries.TOKENIZER).count() == 0


def test_section_counts(make_docs, odd_texts):
    tok = Tokenizer.from_file(queries.TOKENIZER)
    rows = [(k, t) for k, t in enumerate([*odd_texts, "ab cd\nefg é😀\n\n# x\n"])]
    halves = lambda t: [(0, len(t) // 2), (len(t) // 2, len(t))]
    for sections, rule in ((attribution.line_sections, "start"), (halves, "start"), (halves, "end"), (halves, "most")):
        got = {}
        for r in attribution.section_tokens(make_docs(rows), queries.TOKENIZER, sections=sections, rule=rule).collect():
            got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
        for i, t in rows:
            if not t:
                assert i not in got
                continue
            spans = [o for o in tok.encode(t, add_special_tokens=False).offsets]
            assert sum(got.get(i, {}).values()) == len(spans)
            for k, (s, e) in enumerate(sections(t)):
                at = {"start": lambda o: s <= o[0] < e, "end": lambda o: s <= max(o[1] - 1, o[0]) < e}.get(rule)
                if at:
                    assert got[i][k] == sum(map(at, spans))
    with pytest.raises(ValueError, match="no such rule"):
        attribution.allocate(np.array([[0, 1]]), [(0, 1)], "x")


def test_the_query_counts_pages_that_tokens_cross(spark):
    tok, expect, crossed = Tokenizer.from_file(queries.TOKENIZER), {}, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 0").collect():
        counts = {k: [0, 0] for k in range(-(-len(r.text) // 1000))}
        for s, e in tok.encode(r.text, add_special_tokens=False).offsets:
            held = {k: min(e, 1000 * k + 1000) - max(s, 1000 * k) for k in range(s // 1000, (max(e, s + 1) - 1) // 1000 + 1)}
            page = max(held, key=lambda k: (held[k], -k))
            counts[page][0] += 1
            counts[page][1] += len(held) > 1
            crossed += len(held) > 1
        expect |= {(r.doc_id, k): tuple(n) for k, n in counts.items()}
    got = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in queries.op7_section_tokens(spark, SF).collect()}
    assert got == expect and crossed > 100


def test_a_crossing_token_goes_by_the_rule():
    spans, sections = np.array([[0, 5]]), [(0, 2), (2, 9)]
    assert [attribution.allocate(spans, sections, r)[0].tolist() for r in ("start", "end", "most")] == [[0], [1], [1]]
    assert attribution.allocate(spans, sections)[1].tolist() == [True]


def test_the_word_table_holds_no_objects():
    import tracemalloc

    tok, n = tokenout.WordTokenizer(queries.TOKENIZER), 200_000
    words = [f"w{k}é" for k in range(n)]
    tracemalloc.start()
    try:
        ids, lengths = tok.encode([" ".join(words[:n // 2]), " ".join(words), None], 1)
        held = tracemalloc.get_traced_memory()[0] - ids.nbytes - lengths.nbytes
    finally:
        tracemalloc.stop()
    assert held < 60 * n  # numbers of the ids; the words are Arrow's
    some = [0, 7, 99_999, 100_000, n - 1]
    assert tok.encode([words[k] for k in some], 1)[0].tolist() == [i for k in some for i in [*tok.tokenizer.encode(words[k], add_special_tokens=False).ids, 1]]


MEMORY = """
import numpy as np, pyarrow as pa, sys
from factloom.llm import tokenout

def held(name):
    return int(next(x for x in open("/proc/self/status") if x.startswith(name)).split()[1]) >> 10

def batches():
    rng = np.random.default_rng(5)
    for _ in range(3):
        words = rng.integers(97, 123, (1_500_000, 6), np.uint8)
        words[:, 5] = 32
        text = words.tobytes().decode()
        yield pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([text[k * 9000 : (k + 1) * 9000] for k in range(1000)])], names=["key", "text"])

tok, before = tokenout.WordTokenizer(sys.argv[1]), held("VmRSS")
n = sum(len(x[1]) for x in tokenout._coded(batches(), tok, 1))
print(n > 0 and held("VmHWM") - before)
"""


def test_memory_of_a_worker_that_meets_many_words():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", MEMORY, public_tokenizers.path("word_bpe_49k.json")], cwd=root, capture_output=True, text=True, check=True)
    assert 0 < int(done.stdout) < 370  # MB at most besides the tokenizer; 499 with slices of 8 MB whose memory is not given back


def test_words_of_equal_hash_keep_their_own_ids(monkeypatch):
    texts = [f"alpha beta gamma{k % 7} delta'{k} ünder 12{k} x<|y" for k in range(40)]
    path = public_tokenizers.path("word_bpe_49k.json")
    right = tokenout.WordTokenizer(path)
    expect = [right.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    for hashes in (tokenout.hash_spans, lambda data, begin, length: length.astype(np.uint64) % np.uint64(3)):
        monkeypatch.setattr(tokenout, "hash_spans", hashes)
        tok = tokenout.WordTokenizer(path)
        for k in range(0, 40, 10):
            ids, n = tok.encode(texts[k : k + 10], 1)
            assert np.split(ids, np.cumsum(n)[:-1])[9].tolist() == expect[k + 9]
            assert ids.tolist() == [x for e in expect[k : k + 10] for x in e]


def test_places_asks_only_for_what_it_does_not_have():
    table = pa.array([f"w{k}" for k in range(1000)], pa.string())
    places = tokenout._Places()
    places.add(table.slice(0, 400), np.arange(400))
    places.add(table.slice(400), np.arange(400, 1000))
    found, new = places.find(pa.array(["w3", "no", "w999", "", "w" * 200], pa.string()), table)
    assert found.tolist() == [3, -1, 999, -1, -1] and new.to_pylist() == ["no", "", "w" * 200]
    assert tokenout._Places().find(table.slice(0, 2), table)[0].tolist() == [-1, -1]
