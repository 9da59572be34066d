import hashlib
import random

import numpy as np
import pytest
import xxhash

from gavelwork.llm import common, exact_dedup, simhash
from gavelwork.llm.common import with_components
from tests.llm.helpers import ROWS, components, empty, hard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_cuckoo_index_inserts_deletes_and_grows():
    rng, index, live = random.Random(2), exact_dedup.CuckooIndex(4), {}
    for n in range(6000):
        digest = hashlib.sha256(str(rng.randint(0, 900)).encode()).digest()
        if digest in live and rng.random() < 0.5:
            assert index.delete(digest)
            del live[digest]
        elif digest in live:
            assert index.find(digest) == live[digest]
        else:
            index.insert(digest, n)
            live[digest] = n
    assert dict(index.items()) == live and index.n == len(live) and index.buckets > 4
    assert not index.delete(b"x" * 32) and index.find(b"x" * 32) is None


def test_equal_prints_are_told_apart_by_content():
    index = exact_dedup.CuckooIndex(2)
    digests = [b"ab" + bytes(8) + bytes([i]) * 22 for i in range(4)]
    for i, digest in enumerate(digests):
        index.insert(digest, i)
    assert [index.find(d) for d in digests] == [0, 1, 2, 3]


def test_exact_groups(spark):
    rows = exact_dedup.exact_groups(hard(spark)).collect()
    assert len(rows) == len(ROWS)
    by_text = {}
    for doc_id, text, *_ in ROWS:
        by_text.setdefault((text or "").translate(LOWER), []).append(doc_id)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by_text.items()}
    for row in rows:
        ids = digest[row["text_sha256"]]
        assert row["group_size"] == len(ids)
        assert row["keep_id"] == max((i for i in ids if i is not None), default=None)
    for ids in digest.values():
        assert sum(r["kept"] for r in rows if digest[r["text_sha256"]] == ids) == 1
    kept = exact_dedup.deduplicate(hard(spark))
    assert kept.columns == hard(spark).columns and kept.count() == len(digest)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 and exact_dedup.deduplicate(empty(spark)).count() == 0


def mark(text):
    found = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "").translate(LOWER)).split(" ") if w]
    shingles = [" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rows = simhash.simhash_components(hard(spark)).collect()
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in rows) == sorted((i or -1, f"{mark(t):016x}") for i, t, *_ in ROWS)
    known = {i: mark(t) for i, t, *_ in ROWS if i is not None}
    label = components(list(known), lambda a, b: (known[a] ^ known[b]).bit_count() <= 2)
    assert all(r["component_id"] == (label[r["doc_id"]] if r["doc_id"] is not None else None) for r in rows)
    kept = simhash.deduplicate(hard(spark))
    assert kept.columns == hard(spark).columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(label.values())) and ids.count(None) == 2
    assert simhash.simhash_components(empty(spark)).count() == 0 and simhash.deduplicate(empty(spark)).count() == 0


def test_tree_finds_what_a_scan_finds():
    rng, tree = random.Random(4), simhash.BKTree()
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(15)]
    for i, v in enumerate(values):
        tree.add(v, i)
    for v in values[::7]:
        assert sorted(tree.near(v, 2)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2]


@pytest.mark.parametrize("nodes", [3, 4000])
def test_links_keep_all_components(spark, nodes):
    """Chains of near fingerprints, in shards that are cut into small pieces and in whole ones."""
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(40)}
    for start in list(values)[:6]:
        at = start
        for _ in range(12):
            at ^= 1 << rng.randrange(64)
            values.add(at ^ (1 << rng.randrange(40)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fingerprint long, node long")
    found = {r["node"]: r["component"] for r in with_components(simhash.near_links(rows, 2, nodes)).collect()}
    label = components(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= 2)
    assert [found.get(i, i) for i in range(len(values))] == [label[i] for i in range(len(values))]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5), (None, 3), (60, 59)]
    found = {r["node"]: r["component"] for r in with_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 61)}}
    assert with_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_majority_is_strict():
    hashes = np.array([0b11, 0b01, 0b10, 0b01], np.uint64)
    assert simhash._majority(hashes, np.array([0, 2, 2, 4])).tolist() == [0b01, 0, 0]


def jaccard(a, b, shingle=5):
    sets = []
    for text in (a, b):
        found = text.translate(LOWER).split()
        sets.append({tuple(found[i:i + shingle]) for i in range(max(1, len(found) - shingle + 1))} if found else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("piece", [3, 4000])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, piece):
    """Copies with changed words around the similarity, in small pieces of shards and in whole ones."""
    for search in (simhash.nearest_pairs, simhash.joining_links):
        monkeypatch.setattr(search, "__defaults__", (piece,))
    rng, texts = random.Random(3), []
    for _ in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([4, 12, 60, 300]))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 45))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 5000)}"
            texts.append(" ".join(copy))
    texts += [" ".join(["same", "words"] * 200 + [f"end{i}" for i in range(n)]) for n in (0, 1, 30)]
    label = components(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect())
    assert kept == sorted(set(label.values())) and 20 < len(kept) < len(texts) - 10


def test_shards_of_the_near_dedup_come_from_simhash_bits():
    """A band is a run of majority bits of the shingle hashes, mixed anew for every word; long texts take wider lanes."""
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 9, 70_000]
    hashes, bounds = rng.integers(0, 1 << 63, sum(sizes)).astype(np.uint64), np.cumsum([0, *sizes])
    for some in (bounds, bounds[:-1]):
        brute = [[2 * int(((hashes[a:b] >> np.uint64(bit)) & np.uint64(1)).sum()) > b - a for bit in range(64)] for a, b in zip(some[:-1], some[1:])]
        assert simhash._majority(hashes[:some[-1]], some).tolist() == [sum(1 << i for i, on in enumerate(bits) if on) for bits in brute]
    wide = simhash._wide(hashes, bounds)
    bands = simhash._bands(wide)
    assert bands.shape == (5, 40) and bands.min() >= 0 and not bands[0].any()
    assert [int(k) for k in bands[3]] == [int(w) >> 12 * i & 4095 for w in wide[3] for i in range(5)]
    # a set that shares 8 of 9 shingles differs in a few bits of every word, another one in half of them
    near, far = hashes[3:12].copy(), rng.integers(0, 1 << 63, 9).astype(np.uint64)
    near[0] = 7
    words = simhash._wide(np.concatenate([hashes[3:12], near, far]), np.array([0, 9, 18, 27]))
    apart = [int(np.bitwise_count(words[0] ^ words[i]).sum()) for i in (1, 2)]
    assert apart[0] < 130 and apart[1] > 200


def test_shards_send_their_sizes_and_not_the_nodes(spark, tmp_path):
    """Nodes are taken for small before they are repeated for their bands; the sizes of shards turn out larger."""
    rng = np.random.default_rng(1)
    rows = [(i, 5, i, i, i, rng.integers(0, 4096, 40).tolist()) for i in range(500)]
    spark.createDataFrame(rows, "node long, size long, fingerprint long, second long, group long, bands array<smallint>").write.parquet(str(tmp_path / "n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        dealt = simhash.shards(simhash.keyed_nodes(spark.read.parquet(str(tmp_path / "n"))))
        shared = dealt.collect()
        plan = dealt._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    held = {}
    for node, *_, bands in rows:
        for at, key in enumerate(bands):
            held.setdefault((at, key), set()).add(node)
    assert sorted((r["table"], r["key"], r["node"]) for r in shared) == sorted((*k, n) for k, own in held.items() if len(own) > 1 for n in own)
    assert "BuildRight" in plan and "BuildLeft" not in plan


@pytest.mark.parametrize("sent", [0, 64 << 20])
def test_names_of_rows_are_sent_to_all_tasks_while_they_are_small(spark, monkeypatch, tmp_path, sent):
    """Files hold few bytes for many rows; the rows' own size decides, and the result is the same."""
    monkeypatch.setattr(common, "SENT_BYTES", sent)
    spark.createDataFrame([(i, f"text {i % 400} of five words or more") for i in range(2000)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for kept in (exact_dedup.deduplicate(docs), simhash.deduplicate(docs, similarity=1.0)):
        assert len(kept.collect()) == 400
        assert ("BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()) == (sent > 0)
