import re

import numpy as np
import xxhash

from quillspark.llm import simhash


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    top = {i: i for i in fps}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in fps}


def test_fingerprints():
    for t in (None, "", " \t", "One", "One two THREE four five", "É é x y z\x0bw q", "a b " * 500):
        assert simhash.fingerprint(t or "") == plain_fingerprint(t)


def near(rng, n, bits=64):
    fps = [int(x) for x in rng.integers(0, 1 << 63, n, dtype=np.uint64)]
    for _ in range(n):
        fp = fps[rng.integers(len(fps))]
        for b in rng.choice(bits, rng.integers(0, 7), replace=False):
            fp ^= 1 << int(b)
        fps.append(fp)
    return fps


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    # Half of them differ in few bits of one block only, so that groups are large and go a level down.
    fps = dict(enumerate(dict.fromkeys(near(rng, 150) + near(rng, 150, 10) + [int(x) for x in rng.integers(0, 1 << 12, 300)])))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(f), i) for i, f in fps.items()], "fp long, rep long")
    want = plain_components(fps)
    for largest in (8192, 60):
        found = {r.node: r.component for r in simhash.components(simhash.near_links(nodes, 4, largest)).collect()}
        assert {i: found.get(i, i) for i in fps} == want


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_edge_rows(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[4].component_id == 0 and {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[1].fingerprint == "0" * 16
    assert sorted(r.component_id for r in got if r.doc_id is None) == [0, 1]
    assert simhash.near_duplicates(empty).count() == 0
