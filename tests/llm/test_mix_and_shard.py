import hashlib
import re
import zlib
from collections import Counter, defaultdict

from sparkprep.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """The sharing, round by round, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        excess = 0.0
        for s in sorted(free, key=str):
            target[s] += left * weight[s] / whole
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                excess += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
        left = excess
    return target


def check_mix(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target = brute_targets(sizes)
    want = []
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        key = f"20|{'\\N' if r.doc_id is None else r.doc_id}"
        coin = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52 < rate - int(rate)
        want.append((str(r.doc_id), n, sizes[r.source], round(target[r.source], 4), n * (int(rate) + coin)))
    got = [(str(r.doc_id), r["size"], r.source_size, round(r.target, 4), r.taken) for r in mixing.taken(docs).collect()]
    assert sorted(got) == sorted(want)
    return got


def test_mix_against_brute_force(documents, small):
    check_mix(documents)
    check_mix(small)


def test_mix_emits_what_it_says(clashing, none):
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    taken = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert taken == sum(r.taken for r in mixing.taken(clashing).collect())
    assert mixing.mix(none).count() == 0 and mixing.taken(none).count() == 0


def test_many_sources_are_ranked_without_a_single_task(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 AS int)) AS text", "concat('s', id % 500) AS source")
    check_mix(docs)


def brute_shards(positions, shards, nodes, room):
    """The ring row by row: in each round, the rows left of every cell and salt in order."""
    used = [0] * shards
    at = {}
    place = {}
    waiting = sorted(positions)
    for key in waiting:
        at[key] = next((i for i, (c, _) in enumerate(nodes) if c >= key[0]), 0)
    while waiting:
        later = []
        for key in waiting:
            shard = nodes[at[key] % len(nodes)][1]
            if used[shard] < room[shard]:
                place[key] = (shard, used[shard])
                used[shard] += 1
            else:
                at[key] += 1
                later.append(key)
        waiting = later
    return place


def test_ring_against_rows_served_one_by_one(spark):
    nodes = sharding.ring(spark, 5, 4)
    counts = {(cell, cell % 3): 1 + cell * 7 % 11 for cell in range(0, sharding.CELLS, 37)}
    total = sum(counts.values())
    for load in (1.0, 1.3):
        room = sharding.capacities(total, 5, load)
        runs = sharding.allot(counts, nodes, room)
        got = {(c, s, lo + k): (shard, at + k) for c, s, lo, hi, shard, at in runs for k in range(hi - lo)}
        rows = [(c, s, k) for (c, s), n in counts.items() for k in range(n)]
        want = brute_shards(rows, 5, nodes, room)
        assert Counter(v[0] for v in got.values()) == Counter(v[0] for v in want.values())
        assert set(got) == set(rows) and sorted(got.values()) == sorted(want.values())


def test_shards_are_even_and_slots_gapless(clashing, small, none):
    for docs in (clashing, small):
        rows = sharding.shards(docs).collect()
        assert len(rows) == docs.count()
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        sizes = [len(by[s]) for s in range(sharding.SHARDS)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        want = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert sorted((str(r.doc_id), r["size"], r["text_crc32"]) for r in rows) == want
        assert sorted(map(str, rows)) == sorted(map(str, sharding.shards(docs).collect()))
    assert sharding.shards(none).count() == 0


def test_a_shard_more_moves_few_rows_where_loads_leave_room(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r["shard"] for r in sharding.shard(rows, ["doc_id"], shards=10, load=2.0).collect()}
    b = {r.doc_id: r["shard"] for r in sharding.shard(rows, ["doc_id"], shards=11, load=2.0).collect()}
    assert max(Counter(a.values()).values()) <= 800
    assert sum(a[k] != b[k] for k in a) < 0.2 * len(a)


def test_the_ring_is_in_order_of_cells_and_every_shard_is_a_home(spark):
    nodes = sharding.ring(spark, sharding.SHARDS, sharding.NODES)
    cells = [c for c, _ in nodes]
    assert cells == sorted(cells) and Counter(s for _, s in nodes) == dict.fromkeys(range(sharding.SHARDS), sharding.NODES)
    homes = {next((s for c, s in nodes if c >= cell), nodes[0][1]) for cell in range(sharding.CELLS)}
    assert homes == set(range(sharding.SHARDS))


def test_a_new_shard_takes_most_of_what_moves(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id: r["shard"] for r in sharding.shard(rows, ["doc_id"], shards=n, load=1.25).collect()} for n in (24, 25))
    assert set(a.values()) == set(range(24))
    moved = [k for k in a if a[k] != b[k]]
    assert len(moved) < 0.06 * len(a) and sum(b[k] == 24 for k in moved) >= 0.8 * len(moved)


def test_the_shard_does_not_depend_on_where_a_row_was_read(small):
    a, b = ({(r.doc_id, r.text_crc32): (r["shard"], r.slot) for r in sharding.shards(d).collect()} for d in (small, small.repartition(7, "text")))
    assert a == b


def test_one_key_with_a_third_of_the_rows(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id")
    got = Counter(r["shard"] for r in sharding.shard(rows, ["doc_id"]).collect())
    assert sum(got.values()) == 3000 and set(got.values()) == {125}
