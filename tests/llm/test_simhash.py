import random

import numpy as np
import pytest
import xxhash

from fluxmill.llm import simhash


def naive_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ")
    words = [w for w in words if w]
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(prints, radius=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", None, "one", "One two", "a b c", "A b c d É", "x " * 300, "\x1cq r s t"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive_print(text)


def noisy(dice, centres, n):
    out = []
    for _ in range(n):
        p = dice.choice(centres)
        for _ in range(dice.randint(0, 6)):
            p ^= 1 << dice.randrange(64)
        out.append(p)
    return out


def groups_of(prints, links):
    """The place of the first of each one's group, from links between values."""
    place, parent = {p: k for k, p in enumerate(prints)}, list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(place[int(a)]), find(place[int(b)])
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


@pytest.mark.parametrize("tile", [1, 7, 64, 1000])
def test_tiles_equal_all_pairs(tile, monkeypatch):
    """One key, many keys in a tile, and pairs of sides; forests have no link too many."""
    monkeypatch.setattr(simhash, "_LINKS", 50)
    dice = random.Random(1)
    prints = list(dict.fromkeys(noisy(dice, [dice.getrandbits(64) for _ in range(12)], 300)))
    array = np.array(prints, np.uint64)
    a, b = simhash.link_tiles(np.zeros(len(prints), np.int64), array, tile=tile)
    want = naive_groups(prints)
    assert groups_of(prints, zip(a, b)) == want and len(a) == len(prints) - len(set(want))
    key = np.array([dice.randrange(40) for _ in prints])
    near = [(x, y) for x in range(len(prints)) for y in range(x) if key[x] == key[y] and (prints[x] ^ prints[y]).bit_count() <= 3]
    got = simhash.link_tiles(key, array, tile=tile)
    assert groups_of(prints, zip(*got)) == groups_of(prints, [(prints[x], prints[y]) for x, y in near])
    side = np.array([dice.randrange(2) for _ in prints])
    across = [(prints[x], prints[y]) for x, y in near if side[x] != side[y]]
    assert groups_of(prints, zip(*simhash.link_tiles(key, array, side, tile=tile))) == groups_of(prints, across)


def test_tile_pairs_meet_once_within_the_radius(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 16)
    dice = random.Random(6)
    prints = list(dict.fromkeys(dice.getrandbits(12) for _ in range(300)))
    df = spark.createDataFrame([(p, 0, 0) for p in prints], "p long, c int, v long")
    met = {}
    for r in simhash._tile_pairs(df, 1, 3).collect():
        met.setdefault((r["i"], r["j"]), {}).setdefault(r["side"], []).append(r["p"])
    pairs = [(a, b) for sides in met.values() for a in sides.get(0, []) for b in sides.get(1, [])] + [(a, b) for sides in met.values() for a in sides.get(2, []) for b in sides.get(2, []) if a < b]
    pairs = [tuple(sorted(x)) for x in pairs]
    assert len(pairs) == len(set(pairs)) and all(abs(a.bit_count() - b.bit_count()) <= 3 for a, b in pairs)
    assert {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3} <= set(pairs)
    assert max(len(x) for sides in met.values() for x in sides.values()) <= 24


@pytest.mark.parametrize("split", [4096, 8])
@pytest.mark.parametrize("rows", [100, 1 << 40])
def test_links_connect_exactly(spark, monkeypatch, split, rows):
    """Hot blocks dealt to several tasks, and any number of blocks, give the same groups."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    dice = random.Random(2)
    prints = list(dict.fromkeys([0, *noisy(dice, [dice.getrandbits(64) for _ in range(6)], 200)]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "p long")
    links = [(r["a"], r["b"]) for r in simhash.link_prints(df, "p", rows).collect()]
    assert groups_of(signed, links) == naive_groups(prints)


@pytest.mark.parametrize("limit, hot", [(500_000, 100_000), (0, 100_000), (500_000, 4)])
def test_documents(spark, monkeypatch, limit, hot):
    """Also with joins beyond the broadcast's limit, and with fingerprints of many documents."""
    monkeypatch.setattr(simhash, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(simhash.join_salted, "__defaults__", (16, limit))
    dice = random.Random(3)
    words = ["".join(dice.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    base = [" ".join(dice.choice(words) for _ in range(120)) for _ in range(15)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 5] + " tail") for k in range(20)] + [(200 + k, base[7]) for k in range(30)] + [(300, None), (301, ""), (302, " \n"), (3, base[3]), (None, base[2])]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, p int, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = [naive_print(t) for _, t in rows]
    roots = naive_groups(prints)
    least = {r: min(i for (i, _), q in zip(rows, roots) if q == r and i is not None) for r in set(roots)}
    want = sorted((str(i), f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
