import hashlib
import struct
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkprep.llm import multiset, simhash


def brute_print(text):
    """One bit at a time, with plain integers."""
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    rows = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Union-find over all pairs of distinct fingerprints."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, p in prints:
        if k is not None:
            least[find(p)].append(k)
    return [(k, p, min(least[find(p)], default=None)) for k, p in prints]


def check_groups(docs):
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(k), f"{p:016x}", str(c)) for k, p, c in brute_components(rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.groups_of(docs).collect()) == want


def test_groups_against_all_pairs(clashing, small, none):
    check_groups(clashing)
    check_groups(small)
    assert simhash.groups_of(none).count() == 0


def test_links_against_all_pairs(spark):
    """Random fingerprints with many near ones, a chain and both ends of the range."""
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 150)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for b in base for _ in range(3)]
    chain = [(1 << 2 * k) - 1 for k in range(32)]
    prints = sorted({*base, *near, *chain, 0, 2**64 - 1})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for groups in (4, 6, 7):
        got = [(r.a, r.b) for r in simhash.links(frame, groups=groups).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    roots = {r.node: r.root for r in simhash.components(frame.sparkSession.createDataFrame(sorted(want), "a long, b long")).collect()}
    named = brute_components([(s, p) for s, p in zip(signed, prints)])
    assert all(roots.get(k, k) == c for k, _, c in named)


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63 - 1, (300, 2))]
    far = F.bit_count(simhash.unary_counts(F.col("a")).bitwiseXOR(simhash.unary_counts(F.col("b"))))
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", far.alias("far")).collect():
        counts = [[((x >> 2 * s) & 1) + ((x >> 2 * s + 1) & 1) for s in range(32)] for x in (r.a, r.b)]
        assert r.far == sum(abs(p - q) for p, q in zip(*counts)) <= bin((r.a ^ r.b) & (2**64 - 1)).count("1")


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, k) for k in range(501, 900)] + [(2000, 1999), (1999, 1500)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(101)) and all(roots[k] == 500 for k in range(500, 900)) and roots[2000] == 1500


def test_one_document_of_each_group_stays(clashing, small, none):
    for docs in (clashing, small):
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns
        groups = simhash.groups_of(docs).collect()
        assert kept.count() == len({r.component_id if r.component_id is not None else r.fingerprint for r in groups})
    assert {r.doc_id for r in simhash.keep_first(small).collect()} == {r.component_id for r in simhash.groups_of(small).collect()}
    assert simhash.keep_first(none).count() == 0


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 101}" for i in range(500))
    monkeypatch.setattr(simhash, "BLOCK", 37)
    assert simhash.fingerprint(text) == brute_print(text)


# multiset fingerprints


def brute_vector(text):
    lanes = [0] * (multiset.IDENTITY + 1 + 64)
    for p in text.split("\n"):
        for i in range(multiset.IDENTITY):
            seed = xxhash.xxh64_intdigest(struct.pack("<i", i), 42)
            lanes[i] = (lanes[i] + xxhash.xxh64_intdigest(p.encode(), seed)) % 2**32
        import re

        for s in re.split(multiset.SENTENCE, p):
            if s:
                h = xxhash.xxh64_intdigest(s.encode(), 42)
                lanes[multiset.IDENTITY] += 1
                for b in range(64):
                    lanes[multiset.IDENTITY + 1 + b] += h >> b & 1
    head = "".join(f"{v:08x}" for v in lanes[: multiset.IDENTITY + 1])
    counts = lanes[multiset.IDENTITY + 1 :]
    return lanes, head + "".join(f"{counts[b + 32]:08x}{counts[b]:08x}" for b in range(32))


def brute_likeness(a, b):
    if a == b:
        return 1.0
    u, v = (np.array([2 * c - x[multiset.IDENTITY] for c in x[multiset.IDENTITY + 1 :]], float) for x in (a, b))
    size = np.sqrt(u @ u) * np.sqrt(v @ v)
    return max(0.0, min(1.0, float(u @ v / size))) if size else 0.0


def check_edits(docs):
    rows = {(r.doc_id, r.text or ""): r for r in docs.select("doc_id", "text").collect()}
    hashed = sorted(rows, key=lambda k: (k[0] is None, k[0] or 0, (xxhash.xxh64_intdigest(k[1].encode(), 42) + 2**63) % 2**64))
    want = {}
    for key, after in zip(hashed, hashed[1:] + hashed[:1]):
        text, n = key[1], len(key[1])
        edited = text[: n - n // 4] + after[1][: n // 4]
        a, form = brute_vector(text)
        b, edited_form = brute_vector(edited)
        want[key[0], n, form] = (hashlib.sha256(edited.encode()).hexdigest(), edited_form, brute_likeness(a, b), brute_likeness(a, brute_vector(after[1])[0]))
    got = multiset.edits(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        sha, form, near, near_next = want[r.doc_id, r.n_chars, r.fingerprint]
        assert (r.edited_sha256, r.edited_fingerprint) == (sha, form)
        assert abs(r.near_edited - near) < 1e-9 and abs(r.near_next - near_next) < 1e-9


def test_edits_against_brute_force(clashing, small, none):
    check_edits(clashing)
    check_edits(small)
    check_edits(clashing.where("doc_id = 9"))
    assert multiset.edits(none).count() == 0


def test_paragraphs_are_added_and_removed_in_any_order(spark):
    parts = ["first. one!", "second", "", "third, and more. Much more.", "second"]
    row = spark.createDataFrame([("\n".join(parts), "\n".join(parts[::-1]), "\n".join(parts[:2]), "\n".join(parts[2:]))], "a string, b string, c string, d string")
    a, b, c, d = (multiset.vector(F.col(x)) for x in "abcd")
    r = row.select((a == b).alias("order"), (multiset.add(c, d) == a).alias("add"), (multiset.remove(a, d) == c).alias("remove"), (a == c).alias("differ")).first()
    assert (r.order, r["add"], r["remove"], r.differ) == (True, True, True, False)


def test_edited_texts_are_nearer_than_the_next(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 300")
    near, other = multiset.edits(docs).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near > 0.5 > 0.2 > other


def test_each_edited_text_is_nearer_than_the_next(spark):
    import random

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvz", k=rng.randint(2, 9))) for _ in range(4000)]
    hindi = ["".join(chr(rng.randint(0x0915, 0x0939)) for _ in range(rng.randint(2, 6))) for _ in range(2000)]
    texts = []
    for _ in range(6):
        texts.append(" ".join(rng.choices(words, k=400)))
        texts.append("|".join(rng.choices(words, k=400)))
        texts.append(", ".join(rng.choices(words, k=400)))
        texts.append(" ".join(str(rng.randint(0, 999)) for _ in range(400)))
        texts.append(" ".join(w + "।" * (i % 9 == 8) for i, w in enumerate(rng.choices(hindi, k=400))))
        texts.append("".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(800)))
    texts = [t for kind in range(6) for t in texts[kind::6]]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in multiset.edits(made).where("doc_id % 6 <> 5").collect():  # the next is of the same kind
        assert r.near_edited > 0.5 and r.near_edited > r.near_next, texts[r.doc_id][:60]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 300")
    found = multiset.edits(docs)
    wrong = [(r.doc_id, r.n_chars) for r in found.where("near_edited <= near_next").collect()]
    assert len(wrong) <= 0.004 * docs.count(), wrong
