"""Token-ID output: documents as range-coded binary frames in id order, and back.

``write_tokens`` sorts the documents by id, encodes each, and writes frames as
rows of a Parquet table: whole documents of about 64k ids, coded in
independent checksummed blocks of up to 64k ids (rangecoder), with the
documents' ids and lengths beside them.  ``read_tokens`` decodes frames wherever they are, so
reading needs no order and a damaged block stops only its own task.

A tokenizer that splits at white space and drops it, before all else, encodes
a text as its words' ids one after another, so each worker keeps the ids of
the words it has met, up to a bound.  Other tokenizers are refused.

Defined cases: a null or empty text has the end id alone; equal ids stand side
by side, ordered by their texts' hashes; a null id comes first; an empty table
writes no frame; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import rangecoder
from factloom.llm.common import hash_spans, new_path, slices

FRAME_IDS = 1 << 16
_SPACES = (" ", "\n", "  ", "\r\n", "\t", "\v", "\f", " \n \t")
_PROBES = (("the", "end"), ("The", "\u0301x"), ("3", "4"), ("don't", "'s"), ("(", ")"), ("new", "York,"), ("日本", "語"), ("a.", "B"))
GROUP_BLOCKS = 48
WRITTEN_BLOCKS = 16  # the encoder's calls are fewer a block than the decoder's, so more of it may stay in a core's cache
SLICE = 4 << 20  # bytes of text whose words are looked up together


#: The normalizer and pre-tokenizer (fixed values) for which words of Latin letters are cut here as the tokenizer would cut them.
_LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": _CUT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+\\z"  # in NFC, and as long in lower case
_PIECES = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+"


class _Places:
    """Where values stand in a table that grows, by their hashes in order; what is found so is compared with the table's value."""

    def __init__(self) -> None:
        self.hashes, self.places = np.empty(0, np.uint64), np.empty(0, np.int32)

    @staticmethod
    def _hashes(values: pa.Array) -> np.ndarray:
        _, offsets, data = values.buffers()
        ends = np.frombuffer(offsets, np.int32, len(values) + 1, 4 * values.offset).astype(np.int64)
        held = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data else b""
        return hash_spans(held, ends[:-1] - ends[0], np.diff(ends))

    def add(self, values: pa.Array, places: np.ndarray) -> None:
        if len(values):
            h = self._hashes(values)
            order = np.argsort(h)
            at = np.searchsorted(self.hashes, h[order])
            self.hashes, self.places = np.insert(self.hashes, at, h[order]), np.insert(self.places, at, places[order])

    def find(self, values: pa.Array, table: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The place of each value in the table, -1 if it has none, and the values that have none."""
        found = np.full(len(values), -1, np.int64)
        if len(values) and len(self.hashes):
            h = self._hashes(values)
            order = np.argsort(h)
            at = np.minimum(np.searchsorted(self.hashes, h[order]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[order]
            of, place = order[hit], self.places[at[hit]]
            same = pc.equal(values.take(pa.array(of)), table.take(pa.array(place))).to_numpy(zero_copy_only=False)
            found[of[same]] = place[same]
        return found, values.filter(pa.array(found < 0))


class WordTokenizer:
    """Ids of whole texts by a tokenizers file, through a bounded table of the words met so far.

    Words are learnt from the tokenizer by the batch.  If its rules are those
    above, words of Latin letters are first cut into the pieces that its model
    sees, which are fewer than the words, and only new pieces go to the model.
    """

    def __init__(self, path: str, most_words: int = 1_000_000, offsets: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.offsets = Tokenizer.from_file(path), most_words, offsets
        rules = json.loads(self.tokenizer.to_str())
        self.model = None
        suffix = rules["model"].get("end_of_word_suffix")
        if suffix and rules["normalizer"] == _LOWER and rules["pre_tokenizer"] == _SPLIT and all(t["content"].startswith("<|") for t in rules["added_tokens"]):
            self.model = Tokenizer(self.tokenizer.model)
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()
        self.clear_pieces()
        for a, b in _PROBES:
            whole, parts = (self.tokenizer.encode_batch(x, add_special_tokens=False) for x in ([f"{a}{s}{b}" for s in _SPACES], [a, b]))
            if any(e.ids != parts[0].ids + parts[1].ids for e in whole):
                raise ValueError("the tokenizer does not split at white space before all else")

    def clear(self) -> None:
        self.known, self.known_at = pa.array([], pa.binary()), _Places()  # Arrow's arrays: a fraction of the memory of a dict of as many words
        self.ids, self.spans, self.starts = np.empty(0, np.int32), np.empty((0, 2), np.int32), np.zeros(1, np.int64)  # of words; spans: characters of each id in its word, if asked for

    def clear_pieces(self) -> None:
        """Pieces have a bound of their own: they are fewer than words, and only they cost the model's time."""
        self.pieces, self.pieces_at = pa.array([], pa.string()), _Places()
        self.piece_ids, self.piece_spans, self.piece_starts = np.empty(0, np.int32), np.empty((0, 2), np.int32), np.zeros(1, np.int64)

    def _each(self, words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, spans and starts of words by the tokenizer."""
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        ids, spans, lens = [], [np.empty((0, 2), np.int32)], [np.zeros(1, np.int64)]
        for k in range(0, len(words), step):  # encodings are large: only so many at a time
            encoded = encode(words[k : k + step], add_special_tokens=False)
            parts = [e.ids for e in encoded]
            lens.append(np.fromiter(map(len, parts), np.int64, len(parts)))
            ids.append(np.fromiter(chain.from_iterable(parts), np.int32))
            if self.offsets:
                spans.append(np.array([o for e in encoded for o in e.offsets], np.int32).reshape(-1, 2))
        return np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate(spans), np.cumsum(np.concatenate(lens))

    def _joined(self, pieces: list[str], step: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, spans and starts of pieces by the tokenizer's model, many in one text."""
        encode = self.model.encode_batch if self.offsets else self.model.encode_batch_fast
        ids, spans, lens = [], [np.empty((0, 2), np.int32)], [np.zeros(1, np.int64)]
        for k in range(0, len(pieces), 40 * step):
            texts = [pieces[j : j + step] for j in range(k, min(len(pieces), k + 40 * step), step)]
            for words, e in zip(texts, encode([" ".join(t) for t in texts], add_special_tokens=False)):
                ids.append(np.array(e.ids, np.int32))
                last = self.last[ids[-1]]
                if np.count_nonzero(last) != len(words):
                    raise ValueError("the tokenizer's model does not end each word with a token of its own")
                of = np.cumsum(last) - last
                lens.append(np.bincount(of, minlength=len(words)))
                if self.offsets:
                    sizes = np.fromiter(map(len, words), np.int64, len(words))
                    spans.append(np.array(e.offsets, np.int32).reshape(-1, 2) - (np.cumsum(sizes + 1) - sizes - 1)[of, None].astype(np.int32))
        return np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate(spans), np.cumsum(np.concatenate(lens))

    def _by_pieces(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, spans and starts of plain words, each the ids of its pieces one after another; Arrow cuts them, with a space before each piece."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), f"({_PIECES})", r" \1")
        cut = pc.split_pattern(pc.utf8_slice_codeunits(spaced, 1), " ")
        coded = cut.flatten().dictionary_encode()
        found, new = self.pieces_at.find(coded.dictionary, self.pieces)
        if len(new) and len(self.pieces) + len(new) > self.most:
            self.clear_pieces()
            found, new = self.pieces_at.find(coded.dictionary, self.pieces)
        if len(new):
            ids, spans, starts = self._joined(new.to_pylist())
            found[found < 0] = places = len(self.pieces) + np.arange(len(new))
            self.pieces_at.add(new, places)
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.piece_ids, self.piece_spans = np.concatenate([self.piece_ids, ids]), np.concatenate([self.piece_spans, spans])
            self.piece_starts = np.concatenate([self.piece_starts, self.piece_starts[-1] + starts[1:]])
        piece = found[coded.indices.to_numpy()]
        lens = np.diff(self.piece_starts)[piece]
        ends = np.cumsum(lens)
        rows = np.arange(int(lens.sum())) - np.repeat(ends - lens - self.piece_starts[:-1][piece], lens)
        n_pieces = pc.list_value_length(cut).to_numpy().astype(np.int64)
        starts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_pieces)])]
        spans = self.piece_spans
        if self.offsets:
            sizes = pc.utf8_length(cut.flatten()).to_numpy().astype(np.int64)
            before = np.cumsum(sizes) - sizes
            before -= np.repeat(before[np.cumsum(n_pieces) - n_pieces], n_pieces)
            spans = spans[rows] + np.repeat(before, lens)[:, None].astype(np.int32)
        return self.piece_ids[rows], spans, starts

    def learn(self, new: pa.BinaryArray) -> np.ndarray:
        """Add words to the table; their places in it."""
        collects = gc.isenabled()
        gc.disable()  # many small lists that hold no cycles
        try:
            return self._learn(new)
        finally:
            if collects:
                gc.enable()

    def _learn(self, new: pa.BinaryArray) -> np.ndarray:
        words = new.view(pa.string())  # bytes that are no UTF-8 are not plain
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|")) if self.model is not None else pa.array([False] * len(new))
        rest = new.filter(pc.invert(plain))
        parts = [self._by_pieces(words.filter(plain))] if len(rest) < len(new) else []
        if len(rest):
            parts.append(self._each([w.decode("utf-8", "replace") for w in rest.to_pylist()]))
        first = plain.to_numpy(zero_copy_only=False)
        places = len(self.known) + np.where(first, np.cumsum(first), len(new) - len(rest) + np.cumsum(~first)) - 1
        self.known_at.add(new, places)
        self.known = pa.concat_arrays([self.known, new.filter(plain), rest])
        self.ids = np.concatenate([self.ids, *(p[0] for p in parts)])
        self.spans = np.concatenate([self.spans, *(p[1] for p in parts)])
        for p in parts:
            self.starts = np.concatenate([self.starts, self.starts[-1] + p[2][1:]])
        return places

    def places(self, different: pa.BinaryArray) -> np.ndarray:
        """The place in the table of each of different words, those not met so far learnt first."""
        found, new = self.known_at.find(different, self.known)
        if len(new) and len(self.known) + len(new) > self.most:
            self.clear()
            return self.learn(different)
        if len(new):
            found[found < 0] = self.learn(new)
        return found

    def numbers(self, words: list[list[bytes]]) -> np.ndarray:
        """The place in the table of each word of all lists."""
        coded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
        return self.places(coded.dictionary)[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array | list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text with the end id, and their numbers.

        Arrow cuts and numbers the words, so the table is asked once for each different one; the empty
        words that it finds beside white space at the ends of a text have no ids.
        """
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        place, word = self.places(words.dictionary.view(pa.binary())), words.indices.to_numpy()
        n_words = pc.list_value_length(split).to_numpy().astype(np.int64)
        stops = np.cumsum(n_words)
        word = np.insert(word, stops, len(place))  # the end id is one more word, after the table's ids
        first = np.append(self.starts[place], len(self.ids))  # of the different words, fewer than the table's and than all words
        lens = np.append(np.diff(self.starts)[place], 1)[word]
        ends = np.cumsum(lens)
        n_ids = np.diff(ends[stops + np.arange(len(stops))], prepend=0)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total + len(self.ids) < 1 << 31 else np.int64
        rows = np.repeat((first[word] - ends + lens).astype(kind), lens)
        rows += np.arange(total, dtype=kind)
        return np.append(self.ids, np.int32(end)).take(rows), n_ids


@lru_cache(maxsize=2)
def word_tokenizer(path: str, offsets: bool = False) -> WordTokenizer:
    """One tokenizer for all tasks of a worker process, with the words that earlier ones have met."""
    return WordTokenizer(path, offsets=offsets)


def _frames(docs: Iterator[tuple[list, np.ndarray, np.ndarray]]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents (keys, ids, lengths) cut into frames of whole documents."""
    for keys, ids, lengths in docs:
        ends = np.cumsum(lengths)
        first = 0
        while first < len(keys):
            start = ends[first] - lengths[first]
            last = max(first + 1, int(np.searchsorted(ends, start + FRAME_IDS, "right")))
            yield keys[first:last], ids[start : ends[last - 1]], lengths[first:last]
            first = last


def _coded(batches: Iterator[pa.RecordBatch], tok: WordTokenizer, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys, ids and lengths of batches (key, text), a slice at a time."""
    for whole in batches:
        for b in slices(whole, 1, SLICE):
            coded = tok.encode(b.column(1), end_id)
            pa.default_memory_pool().release_unused()  # else a worker holds what its largest slices took
            yield b.column(0).to_pylist(), *coded


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the frames (shard, frame, n_ids, doc_ids, doc_lengths, block_bytes, data) to path."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"shard int, frame int, n_ids long, doc_ids array<{kind}>, doc_lengths array<long>, block_bytes array<int>, data binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, shard, frame = word_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            nonlocal frame
            cuts = [[ids[k : k + rangecoder.BLOCK] for k in range(0, len(ids), rangecoder.BLOCK)] for _, ids, _ in held]
            coded = iter(rangecoder.encode_blocks([x for c in cuts for x in c]))
            data = [[next(coded) for _ in c] for c in cuts]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(held), pa.int32()),
                    pa.array(range(frame, frame + len(held)), pa.int32()),
                    pa.array([len(ids) for _, ids, _ in held], pa.int64()),
                    pa.array([k for k, _, _ in held], pa.list_(id_type)),
                    pa.array([n.tolist() for _, _, n in held], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in d] for d in data], pa.list_(pa.int32())),
                    pa.array([b"".join(d) for d in data], pa.binary()),
                ],
                names=["shard", "frame", "n_ids", "doc_ids", "doc_lengths", "block_bytes", "data"],
            )
            frame += len(held)
            return out

        held, n = [], 0
        for f in _frames(_coded(batches, tok, end_id)):
            held.append(f)
            n += -(-len(f[1]) // rangecoder.BLOCK)
            if n >= WRITTEN_BLOCKS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[doc_id].dataType)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(encode, schema).write.parquet(path)


def read_tokens(frames: DataFrame, each: Callable[[np.ndarray], dict], columns: str) -> DataFrame:
    """(shard, frame, place, doc_id, before, n_tokens, *columns): each(ids) gives the columns of one document; before counts ids of the frame."""
    kind = frames.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at, blocks = 0, [len(x) for x in whole.column(4)]
            while at < whole.num_rows:
                to = at + 1
                while to < whole.num_rows and sum(blocks[at : to + 1]) <= GROUP_BLOCKS:
                    to += 1
                rows = whole.slice(at, to - at).to_pylist()
                cut = [[r["data"][e - n : e] for n, e in zip(r["block_bytes"], np.cumsum(r["block_bytes"]).tolist())] for r in rows]
                ids = iter(rangecoder.decode_blocks([x for c in cut for x in c]))
                out = []
                for r, c in zip(rows, cut):
                    all_ids, start = np.concatenate([next(ids) for _ in c]), 0
                    for place, (key, n) in enumerate(zip(r["doc_ids"], r["doc_lengths"])):
                        out.append({"shard": r["shard"], "frame": r["frame"], "place": place, "doc_id": key, "before": start, "n_tokens": n} | each(all_ids[start : start + n]))
                        start += n
                yield pa.RecordBatch.from_pylist(out, schema)
                at = to

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    layout = f"shard int, frame int, place int, doc_id {kind}, before long, n_tokens long, {columns}"
    schema = to_arrow_schema(StructType.fromDDL(layout))
    return frames.select("shard", "frame", "doc_ids", "doc_lengths", "block_bytes", "data").mapInArrow(decode, layout)


def frame_starts(frames: DataFrame) -> DataFrame:
    """(shard, frame, first): the ids before each frame, over all shards in order."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = frames.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", before(Window.orderBy("shard")).alias("shard_first"))
    inner = frames.select("shard", "frame", F.col("n_ids").alias("n")).select("shard", "frame", before(Window.partitionBy("shard").orderBy("frame")).alias("inner_first"))
    return inner.join(shards, "shard").select("shard", "frame", (F.col("shard_first") + F.col("inner_first")).alias("first"))


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the frames to the shared folder, read them back, and give each document's place and checksum."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, doc_id, text)
    frames = spark.read.parquet(path)
    found = read_tokens(frames, lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}, "ids_crc32 long")
    return found.join(frame_starts(frames), ["shard", "frame"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
