"""Removal of byte strings that another document has, by suffix arrays over shards of the corpus.

Each document's windows (strings of ``LENGTH`` bytes) are dealt to shards by content: a window's key is the least hash of
the ``GRAM``-byte strings in it, and consecutive windows with one key form a segment. Equal windows have equal keys, so a
shard sees all of them; keys met in one document only are left out first (a pass over hashes alone). Equal segments
become one before they are shuffled, with the smallest doc_id, so what many documents share is small. A shard
concatenates its segments, builds their suffix array by induced sorting and the permuted common prefixes (``suffixes``);
runs of suffixes with ``LENGTH`` bytes in common are the equal windows, and a window goes where its document is not the
smallest of its run. Removed stretches return to the documents.

In Spark: documents are dealt to chunks by a hash of doc_id; the texts are shuffled once and read by three stages (that
exchange is reused). Buckets of keys, chunks and shards are counted from the bytes of the corpus. A key with more than
``HOT`` segments is dealt by single windows instead, where equal ones are one again; so no shard grows with a hot
passage. A shard's suffix arrays are built over ``PART`` bytes at a time, never dividing a key.

Defined cases: a null or empty text has no bytes; a text shorter than a window loses none; repeats inside a document are
no reason to remove; rows with equal doc_ids don't remove each other's bytes; a null doc_id counts as larger than all;
other columns are ignored; long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes

LENGTH = 50
#: Bytes hashed for a window's key: the least of the hashes of all such strings in it.
GRAM = 20
#: Bytes of text in a chunk of documents, for each bucket of keys and for each shard of segments.
CHUNK = 8_000_000
#: A key with more different segments is dealt by single windows.
HOT = 20_000
#: Bytes in one suffix array, while keys are small.
PART = 2_000_000
#: Windows hashed at a time.
BLOCK = 1 << 17
LAST = (1 << 63) - 1
PLACE = np.uint64((1 << 18) - 1)  # room for a place in a block


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(block: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` (16 to 24) bytes from every position on."""
    words = suffixes.words_at(block, 0)[: len(block) - 7].copy()
    n = len(block) - GRAM + 1
    h = words[:n] * np.uint64(0xD6E8FEB86659FD93)
    h = mixed(h) + words[8 : 8 + n]
    h = mixed(h) + words[GRAM - 8 : GRAM - 8 + n]
    return mixed(h)


def least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of every ``wide`` neighbours, by doubling."""
    size = 1
    while 2 * size <= wide:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (wide - size)], values[wide - size :]) if wide > size else values


def segments(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and key of every segment of the concatenated documents that end at ``ends``."""
    crosses = np.zeros(len(text) + 1, np.int32)
    begins = np.r_[0, ends[:-1]]
    np.add.at(crosses, np.maximum(ends - LENGTH + 1, begins), 1)
    np.add.at(crosses, ends, -1)
    inside = np.cumsum(crosses[:-1]) == 0
    found = []
    for at in range(0, len(text) - LENGTH + 1, BLOCK):
        block = text[at : at + BLOCK + LENGTH - 1]
        hashes = grams(block)
        place = (least((hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), LENGTH - GRAM + 1) & PLACE).astype(np.int64)
        good = inside[at : at + len(place)]
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (good[1:] != good[:-1])])
        windows = np.diff(np.r_[new, len(place)])
        keep = good[new]
        new, windows = new[keep], windows[keep]
        found.append((at + new, windows, mixed(hashes[place[new]])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(f) for f in zip(*found))


class Chunk:
    """The documents of a chunk in order of doc_id, as one array of bytes, with its segments."""

    def __init__(self, table: pa.Table, buckets: int, cut: bool = True):
        ids = table.column("doc_id").combine_chunks()
        texts = table.column("text").combine_chunks().to_pylist()
        rank = np.array([LAST if v is None else v for v in ids.to_pylist()], np.int64)
        self.order = np.array(sorted(range(len(texts)), key=lambda i: (rank[i], texts[i])), np.int64)
        texts = [texts[i] for i in self.order]
        self.rank = rank[self.order]
        self.ids = ids.take(pa.array(self.order))
        self.ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        if not cut:
            return
        self.start, self.windows, self.key = segments(self.text, self.ends)
        self.doc = self.rank[np.searchsorted(self.ends, self.start, side="right")]
        # keys are sent as five bytes; the bucket says more
        self.code = (self.key >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40) | self.key & np.uint64((1 << 40) - 1)
        self.codes, self.of = np.unique(self.code, return_inverse=True)

    def bucket_slices(self) -> Iterator[tuple[int, slice]]:
        bucket = self.codes >> np.uint64(40)
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        for a, b in zip(at, np.r_[at[1:], len(bucket)]):
            yield int(bucket[a]), slice(int(a), int(b))


def same_text(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from ``a`` and ``b`` on are equal (eight at a time; the last ones overlap)."""
    equal = np.ones(len(a), bool)
    for at in range(0, int(length.max(initial=0)), 8):
        here = np.minimum(at, length - 8)
        equal &= words[a + here] == words[b + here]
    return equal


def keys_of(buckets: int):
    """For each bucket the chunk's keys, and of each how many segments (at most 127) and whether two documents have it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk = Chunk(table, buckets)
        many = np.minimum(np.bincount(chunk.of, minlength=len(chunk.codes)), 127)
        first, last = np.full(len(chunk.codes), LAST), np.full(len(chunk.codes), -LAST)
        np.minimum.at(first, chunk.of, chunk.doc)
        np.maximum.at(last, chunk.of, chunk.doc)
        info = (many | (last > first) << 7).astype(np.uint8)
        raw = chunk.codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        rows = [(b, key[0].as_py(), raw[s].tobytes(), info[s].tobytes()) for b, s in chunk.bucket_slices()]
        return pa.table(list(zip(*rows)) or [[]] * 4, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("codes", pa.binary()), ("info", pa.binary())]))

    return run


def repeated(hot: int):
    """For each chunk which of its keys in this bucket are met in two documents (1) and which are hot (2)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(c, np.uint8).reshape(-1, 5) for c in table.column("codes").to_pylist()]
        sizes = [len(r) for r in raw]
        codes = np.zeros((sum(sizes), 8), np.uint8)
        codes[:, :5] = np.concatenate(raw)
        codes = codes.view("<u8").ravel()
        info = np.frombuffer(b"".join(table.column("info").to_pylist()), np.uint8)
        order = np.argsort(codes)
        new = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        spans = np.diff(np.r_[new, len(codes)])
        told = (spans > 1) | (np.maximum.reduceat(info[order], new) > 127)
        heavy = told & (np.add.reduceat((info[order] & 127).astype(np.int64), new) > hot)
        flags = np.empty(len(codes), np.uint8)
        flags[order] = np.repeat(told.astype(np.uint8) + heavy, spans)
        cut = np.cumsum(sizes)[:-1]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "flags": pa.array([f.tobytes() for f in np.split(flags, cut)], pa.binary())})

    return run


SEGMENTS = "shard long, chunk long, keys binary, docs binary, sizes binary, text binary, owners binary, starts binary, gone binary"
SEGMENT_SCHEMA = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *[(n, pa.binary()) for n in ("keys", "docs", "sizes", "text", "owners", "starts", "gone")]])


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the union of intervals."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return np.column_stack([start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]]).astype(np.int64)


def segments_of(buckets: int, shards: int):
    """The chunk's different segments with repeated keys, for the shards; what equals a smaller document's of the chunk is gone."""

    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(docs, buckets)
        flags = np.zeros(len(chunk.codes), np.uint8)
        sent = dict(zip(replies.column("bucket").to_pylist(), replies.column("flags").to_pylist()))
        for bucket, some in chunk.bucket_slices():
            flags[some] = np.frombuffer(sent[bucket], np.uint8)
        flags = flags[chunk.of]
        keep, hot = flags == 1, np.flatnonzero(flags == 2)
        # each window of a hot key is a segment of its own, keyed by all of its bytes
        words = suffixes.words_at(chunk.text)
        single = np.repeat(chunk.start[hot], chunk.windows[hot])
        single = single + np.arange(len(single)) - np.repeat(np.cumsum(chunk.windows[hot]) - chunk.windows[hot], chunk.windows[hot])
        own = np.zeros(len(single), np.uint64)
        for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            own = mixed(own + words[single + at])
        start = np.concatenate([chunk.start[keep], single])
        length = np.concatenate([chunk.windows[keep], np.ones(len(single), np.int64)]) + LENGTH - 1
        code = np.concatenate([chunk.key[keep], own])
        doc = np.concatenate([chunk.doc[keep], np.repeat(chunk.doc[hot], chunk.windows[hot])])
        order = np.argsort(start, kind="stable")
        start, length, code, doc = start[order], length[order], code[order], doc[order]
        # equal segments: candidates by a hash of place-independent content, then by their bytes
        content = mixed(code + length.astype(np.uint64))
        for at in (0, 16, 32, LENGTH - 8):
            content = mixed(content + words[start + at])
        content = mixed(content + words[start + length - 8])
        _, first, of = np.unique(content, return_index=True, return_inverse=True)
        head = first[of] if len(of) else np.zeros(0, np.int64)
        head = np.where((code[head] == code) & (length[head] == length) & same_text(words, start[head], start, np.where(length[head] == length, length, 8)), head, np.arange(len(head)))
        later = doc > doc[head]
        gone = merged(start[later], (start + length)[later])
        shard = (code % np.uint64(shards)).astype(np.int64)
        stay = np.flatnonzero(~later)
        stay = stay[np.lexsort((stay, head[stay], shard[stay]))]
        rows = []
        at = np.flatnonzero(np.r_[True, np.diff(shard[stay]) != 0]) if len(stay) else np.zeros(0, int)
        for a, b in zip(at, np.r_[at[1:], len(stay)]):
            some = stay[a:b]
            heads = np.flatnonzero(head[some] == some)
            owners = (np.cumsum(head[some] == some) - 1).astype("<u4")
            which = some[heads]
            text = b"".join(chunk.text[s : s + n].tobytes() for s, n in zip(start[which].tolist(), length[which].tolist()))
            rows.append((int(shard[some[0]]), key[0].as_py(), code[which].tobytes(), doc[which].tobytes(), length[which].astype("<u2").tobytes(), text, owners.tobytes(), start[some].tobytes(), b""))
        if len(gone):
            rows.append((key[0].as_py() % shards, key[0].as_py(), *[b""] * 6, gone.tobytes()))
        return pa.table(list(zip(*rows)) or [[]] * 9, schema=SEGMENT_SCHEMA)

    return run


def repeated_windows(texts: list[bytes], keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For different texts, in order of key: which windows (all of each text, one after the other) a smaller document has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = sizes - LENGTH + 1
    out = np.zeros(int(windows.sum()), bool)
    first = np.cumsum(windows) - windows
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    spans = np.diff(np.r_[new, len(keys)])
    rows = np.flatnonzero(np.repeat(spans > 1, spans))  # a key's only text is in no other document
    if not len(rows):
        return out
    reach = np.cumsum(sizes[rows] + 1)
    part = reach // PART
    part = part[np.searchsorted(keys[rows], keys[rows], side="left")]  # a key stays in one part
    for some in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
        text = np.frombuffer(b"\xff".join(texts[i] for i in some) + b"\xff", np.uint8) + np.uint8(1)  # 0 ends a segment
        doc = np.repeat(docs[some], sizes[some] + 1)
        order = suffixes.suffix_array(text, 256)
        shared = suffixes.common_prefixes(text, order)[order]
        runs = np.flatnonzero(np.r_[True, shared[1:] < LENGTH])
        smallest = np.repeat(np.minimum.reduceat(doc[order], runs), np.diff(np.r_[runs, len(order)]))
        repeat = np.zeros(len(text), bool)
        repeat[order] = smallest < doc[order]
        at = np.cumsum(sizes[some] + 1) - sizes[some] - 1
        count = windows[some]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(first[some], count) + within] = repeat[np.repeat(at, count) + within]
    return out


def shard_stretches(table: pa.Table) -> pa.Table:
    """For each chunk the stretches that go, as rows (start, end) in its concatenated bytes."""
    rows = table.to_pylist()
    number: dict[bytes, int] = {}
    texts, keys, least_doc, copies, copy_doc, counts = [], [], [], [], [], []
    for row in rows:
        at, mine = 0, np.frombuffer(row["keys"], np.uint64).tolist()
        docs = np.frombuffer(row["docs"], np.int64).tolist()
        counts.append(len(mine))
        for size, key, doc in zip(np.frombuffer(row["sizes"], "<u2").tolist(), mine, docs):
            text = row["text"][at : at + size]
            at += size
            n = number.setdefault(text, len(texts))
            if n == len(texts):
                texts.append(text)
                keys.append(key)
                least_doc.append(doc)
            elif doc < least_doc[n]:
                least_doc[n] = doc
            copies.append(n)
        copy_doc += docs
    keys, least_doc = np.array(keys, np.uint64), np.array(least_doc, np.int64)
    order = np.argsort(keys, kind="stable")
    repeat = repeated_windows([texts[i] for i in order], keys[order], least_doc[order])
    windows = np.fromiter(map(len, texts), np.int64, len(texts)) - LENGTH + 1
    begin = np.empty(len(texts), np.int64)
    begin[order] = np.cumsum(windows[order]) - windows[order]
    copies, copy_doc = np.array(copies, np.int64), np.array(copy_doc, np.int64)
    out: dict[int, list[np.ndarray]] = {}
    at = 0
    for row, count in zip(rows, counts):
        found = out.setdefault(row["chunk"], [])
        if row["gone"]:
            found.append(np.frombuffer(row["gone"], np.int64).reshape(-1, 2))
        owner = np.frombuffer(row["owners"], "<u4").astype(np.int64) + at
        start = np.frombuffer(row["starts"], np.int64)
        at += count
        segment = copies[owner]
        whole = copy_doc[owner] > least_doc[segment]
        found.append(merged(start[whole], start[whole] + windows[segment[whole]] + LENGTH - 1))
        segment, start = segment[~whole], start[~whole]
        count = windows[segment]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hit = np.flatnonzero(repeat[np.repeat(begin[segment], count) + within])
        places = (np.repeat(start, count) + within)[hit]
        found.append(merged(places, places + LENGTH))
    told = [(chunk, merged(*np.concatenate(parts).T).tobytes()) for chunk, parts in out.items()]
    told = [t for t in told if t[1]]
    return pa.table(list(zip(*told)) or [[]] * 2, schema=pa.schema([("chunk", pa.int64()), ("gone", pa.binary())]))


def kept_of(key: tuple, docs: pa.Table, stretches: pa.Table) -> pa.Table:
    chunk = Chunk(docs, 1, cut=False)
    parts = [np.frombuffer(g, np.int64).reshape(-1, 2) for g in stretches.column("gone").to_pylist()]
    gone = merged(*np.concatenate(parts).T) if parts else np.zeros((0, 2), np.int64)
    # stretches of neighbouring documents may meet: cut them at the ends of documents
    ends, begins = chunk.ends, np.r_[0, chunk.ends[:-1]]
    whole = chunk.text.tobytes()
    low, high = np.searchsorted(gone[:, 1], begins, side="right"), np.searchsorted(gone[:, 0], ends, side="left")
    spans, kept = [], []
    for a, b, i, j in zip(begins.tolist(), ends.tolist(), low.tolist(), high.tolist()):
        mine = [(max(s, a) - a, min(e, b) - a) for s, e in gone[i:j].tolist()] if b > a else []
        at, left = a, []
        for s, e in mine:
            left.append(whole[at : a + s])
            at = a + e
        left.append(whole[at:b])
        spans.append([{"start": s, "end": e} for s, e in mine])
        kept.append(b"".join(left))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": chunk.ids, "n_bytes": pa.array(ends - begins, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})


def without_repeats(docs: DataFrame, chunk_bytes: int = CHUNK, hot: int = HOT) -> DataFrame:
    """For every document doc_id, ``n_bytes``, the removed ``spans`` (start, end; in bytes) and the ``kept`` bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = total // chunk_bytes + 1
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), "doc_id", text)
    keys = dealt.groupBy("chunk").applyInArrow(keys_of(chunks), "bucket long, chunk long, codes binary, info binary")
    flags = keys.groupBy("bucket").applyInArrow(repeated(hot), "chunk long, bucket long, flags binary")
    found = dealt.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(segments_of(chunks, chunks), SEGMENTS)
    gone = found.groupBy("shard").applyInArrow(shard_stretches, "chunk long, gone binary")
    return dealt.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(kept_of, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """The query's digest of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
