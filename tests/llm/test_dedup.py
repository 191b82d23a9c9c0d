"""Suffix-array dedup, SimHash and MinHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.helpers import awkward, awkward_rows, docs_of, empty, prose
from zonewright.llm import minhash, simhash, suffixes
from zonewright.llm.components import components

SF = "/root/testdata/sf0.001"


def texts_of(spark, sf=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def removed(rows):
    """Brute force over all 100-byte strings, in the order of (id, nulls last, text)."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        edges = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(data) else 0
        out.append((i, len(data), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_agrees_with_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    assert as_rows(suffixes.query(spark, SF)) == sorted(removed(texts_of(spark).items()), key=str)


def test_suffix_dedup_of_awkward_rows(spark):
    docs = awkward(spark)
    got = as_rows(suffixes.deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == sorted(removed([r[:2] for r in awkward_rows()]), key=str)
    assert suffixes.cleaned(docs).columns == docs.columns
    assert suffixes.deduplicate(empty(spark)).count() == 0


def test_suffix_dedup_within_a_text_and_across_pieces(spark):
    block = prose(3, 60)
    texts = [block + block, "ab" * 400, "é" * 300, block[:99], block[1:150], "\x00" * 250]
    got = as_rows(suffixes.deduplicate(docs_of(spark, texts)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == sorted(removed(enumerate(texts)), key=str)


def test_anchors_split_long_texts_alike():
    data = np.frombuffer(prose(5, 5000).encode(), np.uint8)
    at = np.array([0, len(data)])
    pieces = [p for p in suffixes._pieces(at, 4096)]
    whole = {(a, b): h for _, a, b, h in zip(*suffixes.anchors(data, at))}
    starts = set()
    for _, _, lo, hi in pieces:
        _, a, b, h = suffixes.anchors(data[lo:hi], np.array([0, hi - lo]))
        for x, y, z in zip(a + lo, b + lo, h):
            assert any(x >= p and y <= q and z == v for (p, q), v in whole.items() if p <= x <= q)
            starts |= set(range(x, y + 1))
    assert starts == set(range(len(data) - 99))


def test_runs_keep_the_earliest_of_equal_strings():
    r, runs, rows, gone = random.Random(3), suffixes.Runs(), [], []
    for _ in range(60):
        batch = [("%099d" % r.randrange(300) + "\x01", r.randrange(1000), r.randrange(50)) for _ in range(r.randint(1, 40))]
        rows += batch
        k, s = runs.add(np.array([x[0].encode() + b"\x01" for x in batch], "S101"), *(np.array([x[i] for x in batch], np.int64) for i in (1, 2)))
        gone += zip(k.tolist(), s.tolist())
    first = {}
    for text, k, s in rows:
        first[text] = min(first.get(text, (k, s)), (k, s))
    assert sorted(gone + [*first.values()]) == sorted((k, s) for _, k, s in rows)
    assert len(runs.runs) < 8 and sum(len(x[0]) for x in runs.runs) == len(first)


def test_cut_leaves_whole_characters():
    assert suffixes.without("aéb", [(2, 3)]) == "aéb"
    assert suffixes.without("aéb", [(1, 3)]) == "ab"


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, near):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x in ids:
        for y in ids:
            if x < y and near(prints[x], prints[y]) and find(x) != find(y):
                root[max(find(x), find(y))] = min(find(x), find(y))
    return {i: find(i) for i in ids}


def test_simhash_agrees_with_brute_force(spark):
    prints = {i: brute_fingerprint(t) for i, t in texts_of(spark).items()}
    groups = brute_components(prints, lambda x, y: (x ^ y).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


@pytest.mark.parametrize(("hot", "block", "plan"), [(128, 2048, 0), (2, 40, 0), (5, 64, 1)])
def test_links_connect_what_brute_force_does(spark, monkeypatch, hot, block, plan):
    monkeypatch.setattr(simhash, "PLANS", simhash.PLANS[plan : plan + 1])
    r = random.Random(hot)
    values = {0x123456789ABCDEF ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 5))) for _ in range(250)} | {r.getrandbits(63) for _ in range(60)}
    values = {i: v for i, v in enumerate(sorted(values))}
    groups = brute_components(values, lambda x, y: (x ^ y).bit_count() <= 4)
    entries = spark.createDataFrame([(v,) for v in values.values()], "_fp long")
    got = {x["node"]: x["root"] for x in components(simhash.links(entries, hot=hot, block=block)).collect()}
    assert {i: got.get(v, v) for i, v in values.items()} == {i: values[g] for i, g in groups.items()}


def test_simhash_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(awkward_rows())
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 5)} == {3}  # without words: one group
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and 2 not in ids and 1 in ids
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_of_each_tells_rows_without_own_id_apart(spark):
    texts = [prose(i, 80) for i in range(6)]
    kept = simhash.one_of_each(docs_of(spark, [*texts, texts[0]], [None] * 7))
    assert sorted(r["text"] for r in kept.collect()) == sorted(texts)
    for copy, other in (("a ", "z "), ("z ", "a ")):  # the copy is the first of its id by text, or the last
        base = prose(7, 300)
        rows = [(1, base), (2, copy + base), (2, other + prose(8, 300)), (3, other + prose(8, 300))]
        kept = simhash.one_of_each(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept) == [rows[0], rows[2]]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_next(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        cut = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_minhash_pairs_each_text_with_the_next(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = minhash.compare_next(docs, n_parts=parts)
    assert as_rows(got.select("doc_id", "n_chars", "edited_sha256")) == brute_next(texts_of(spark).items())
    rows = {r["doc_id"]: r for r in got.collect()}
    own = {r["_id"]: r["fingerprint"] for r in minhash.fingerprint(docs).collect()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == own
    ids, texts = sorted(own), texts_of(spark)
    for i, following in zip(ids[1:], ids):
        t, n = texts[i], texts[following]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert rows[i]["near_edited"] == pytest.approx(jaccard(t, edited), abs=0.2)
        assert rows[i]["near_next"] == pytest.approx(jaccard(t, n), abs=0.2)


def jaccard(a, b):
    a, b = (set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_minhash_of_awkward_rows(spark):
    got = minhash.compare_next(awkward(spark), n_parts=3)
    assert as_rows(got.select("doc_id", "n_chars", "edited_sha256")) == brute_next([r[:2] for r in awkward_rows()])
    assert minhash.compare_next(empty(spark), n_parts=3).count() == 0
    assert len(minhash.compare_next(docs_of(spark, ["a b c"]), n_parts=2).collect()) == 1


def test_signatures_do_not_depend_on_the_block():
    texts = [prose(i, 5 + i % 40) for i in range(50)] + ["", "one"]
    together = minhash.signatures(pa.array(texts))
    assert all((minhash.signatures(pa.array([t]))[0] == together[i]).all() for i, t in enumerate(texts))


def test_minhash_links(spark):
    base = prose(1, 400).split()
    texts = [" ".join(base), " ".join([*base[:200], "changed", *base[200:]]), prose(2, 400), "", None, " "]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3}
    assert minhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_minhash_links_are_of_exact_similarity(spark, block):
    pairs = {}
    for k in range(40):  # the last words changed: 80 of 100 shingles in common, or 79 of 99
        words = [f"w{k}x{i}" for i in range(94 - k % 2)]
        pairs[2 * k], pairs[2 * k + 1] = " ".join(words), " ".join([*words[:-10], *[f"v{k}x{i}" for i in range(10)]])
    docs = docs_of(spark, pairs.values())
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, block=block).collect()}
    assert all((got[2 * k] == got[2 * k + 1]) == (jaccard(pairs[2 * k], pairs[2 * k + 1]) >= 0.8) for k in range(40))
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(40)) == 20


def test_minhash_links_against_all_pairs(spark):
    """Of the links of the documents whose id is divisible by 20 with all others, none is lost."""
    sf = "/root/testdata/sf0.01"
    sets = {i: {*zip(*[t.split()[k:] for k in range(5)])} or {(*t.split(),)} for i, t in texts_of(spark, sf).items()}
    rows = minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    linked = [(i, j) for i in sets if i % 20 == 0 for j in sets if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(got) == len(sets) and linked and all(got[i] == got[j] for i, j in linked)
    near = {frozenset(p) for p in linked}
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, []).append(i)
    pairs = {frozenset((i, j)) for own in groups.values() if len(own) == 2 and any(i % 20 == 0 for i in own) for i, j in [own]}
    assert pairs <= near


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "other words here"), (None, None)], "doc_id string, text string")
    for found in (simhash.near_duplicates(docs), minhash.near_duplicates(docs)):
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {"a": "a", "b": "a", "c": "c", None: None}
    assert as_rows(minhash.compare_next(docs).select("doc_id", "n_chars")) == [("a", 5), ("b", 5), ("c", 16), (None, 0)]
    assert sorted(r["n_removed"] for r in suffixes.deduplicate(docs).collect()) == [0, 0, 0, 0]
    assert sorted(simhash.one_of_each(docs).columns) == ["doc_id", "text"]


def test_rows_without_ids_are_compared_in_many_partitions(spark):
    texts = [prose(i, 60) for i in range(50)]
    docs = docs_of(spark, texts, [None] * 50)
    got = minhash.compare_next(docs, n_parts=8)
    assert as_rows(got.select("doc_id", "n_chars", "edited_sha256")) == brute_next((None, t) for t in texts)


def test_minhash_blocks_of_a_crowded_band(spark):
    base = prose(1, 300)
    texts = [f"{base} tail{i}" for i in range(30)] + [prose(9, 300)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts), block=8).collect()}
    assert got == {i: 0 for i in range(30)} | {30: 30}
