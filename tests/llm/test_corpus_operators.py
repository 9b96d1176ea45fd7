"""Operators that compare texts with each other, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leadmill.llm import components, induced_sort, minhash, sharding, suffix_dedup


def _assert_sorted(text, depth, order, prefix):
    cut = [tuple(text[i : i + depth]) for i in range(len(text))]
    assert sorted(order.tolist()) == list(range(len(text)))
    for a, b, n in zip(order, order[1:], prefix[1:]):
        assert cut[a] <= cut[b]
        same = next((i for i, (x, y) in enumerate(zip(cut[a], cut[b])) if x != y), min(len(cut[a]), len(cut[b])))
        assert n == same


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    for k in range(300):
        depth = int(rng.choice([3, 5, 20]))
        text = np.append(rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 60))), 0).astype(np.uint16)
        order, prefix, _ = induced_sort.suffix_order(text, 8, depth, memory=64 if k % 2 else 1 << 20)
        _assert_sorted(text, depth, order, prefix)


def test_a_shard_of_many_times_the_memory_is_sorted_on_disk(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(1, 30, 700)
    parts = [np.full(500, 3), np.tile([4, 5], 200), np.tile([7, 3, 9], 150), np.tile(base[:9], 40)]
    for _ in range(40):
        at = int(rng.integers(0, 600))
        parts += [base[at : at + int(rng.integers(1, 300))], rng.integers(1, 30, int(rng.integers(0, 40)))]
    text = np.append(np.concatenate(parts), 0).astype(np.uint16)
    levels, real = [], induced_sort._Level
    monkeypatch.setattr(induced_sort, "_Level", lambda text, n, symbols, disk: levels.append(n) or real(text, n, symbols, disk))
    memory = 1024
    assert 2 * len(text) > 8 * memory
    order, prefix, files = induced_sort.suffix_order(text, 32, 100, memory)
    _assert_sorted(text, 100, order, prefix)
    assert files > 10 and len(levels) > 2 and levels == sorted(levels, reverse=True)  # on disk, and several levels of recursion
    whole, _, none = induced_sort.suffix_order(text, 32, 100, 1 << 24)
    assert none == 0 and len(whole) == len(order)


def test_names_of_small_texts_take_no_induction(monkeypatch):
    rng = np.random.default_rng(6)
    for k in range(60):
        text = rng.integers(1, 4, 90)
        text = np.append(np.where(text == 1, 300, np.tile(text[:8], 12)[:90] if k % 2 else text), 0).astype(np.uint16)
        for memory, more in ((8, 1), (1 << 20, 0)):
            runs, levels, real, level = [], [], induced_sort._induce, induced_sort._Level
            with monkeypatch.context() as m:
                m.setattr(induced_sort, "_induce", lambda *a: runs.append(1) or real(*a))
                m.setattr(induced_sort, "_Level", lambda *a: levels.append(1) or level(*a))
                order, prefix, _ = induced_sort.suffix_order(text, 301, 40, memory)
            _assert_sorted(text, 40, order, prefix)
            assert len(runs) > len(levels) if more else len(runs) == len(levels)


def test_common_prefixes_of_long_repeats():
    rng = np.random.default_rng(7)
    for kind in (np.uint8, np.int32):
        n = 900
        text = np.zeros(n + induced_sort.AHEAD, dtype=kind)
        text[:n] = np.tile(rng.integers(1, 9, 300), 3)
        text[rng.integers(0, n, 3)] = 9
        a, b, most = rng.integers(0, n, 400), rng.integers(0, 3, 400) * 300, rng.integers(0, 500, 400)
        b = (a + b) % n
        for x, y, k, found in zip(a, b, most, induced_sort.common_prefix(text, n, a, b, most)):
            limit = min(k, n - max(x, y))
            assert found == next((i for i in range(limit) if text[x + i] != text[y + i]), limit)


def _removed(texts, length):
    counts = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def test_repeated_passages_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    filler = lambda n: "".join(rng.choice("abcdefg éß") for _ in range(n))
    passage, other = filler(700), filler(450)
    texts = [filler(300), passage, filler(200) + passage[:500] + filler(100), filler(50) + passage[100:] + filler(9), other + "x" + other, filler(900), "a" * 1500, "", passage, filler(399) + other[:399]]
    texts += [filler(rng.randint(0, 400)) + passage[rng.randint(0, 250) :] + filler(30) for _ in range(12)]
    docs = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(50, None)], "doc_id long, text string")
    want = {i if i != 5 else None: row for i, row in enumerate(_removed([t.encode() for t in texts], 400))} | {50: (0, 0, 0, hashlib.sha256(b"").hexdigest())}
    for hot, memory, shard in ((suffix_dedup.HOT, suffix_dedup.MEMORY, suffix_dedup.SHARD_BYTES), (1, 4096, 3000), (0, 1 << 20, 9000)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "MEMORY", memory)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
        assert {r[0]: tuple(r[1:5]) for r in suffix_dedup.removals(docs).collect()} == want


def test_neighbouring_sides_are_sorted_as_one_piece(spark):
    # Three near copies: both sides of a segment are met, and without a common home each side brings 399 bytes of its own.
    sides = [(doc, 10 * doc + part, bytes([doc]) * 16 + b"\0\0\0\0", 100 * part, 100 * part + 100, 70 - 10 * part, 3) for doc in (1, 2, 3) for part in (0, 1, 2, 3)]
    sides += [(4, 1, b"\4" * 16 + b"\0\0\0\0", 500, 600, 40, 3), (4, 2, b"\4" * 16 + b"\0\0\0\0", 600, 700, 5, 900)]
    frame = spark.createDataFrame(sides, "a long, b long, one binary, low int, high int, group long, n int").withColumn("first", F.lit(0))
    homes = {(r.a, r.low): (r.group, r.new) for r in suffix_dedup._homes(frame).collect()}
    assert [homes[2, low] for low in (0, 100, 200, 300)] == [(50, True), (40, False), (40, False), (40, False)]
    assert homes[4, 500] == (40, True) and homes[4, 600] == (5, False)  # the common one neither moves nor leads
    text = bytes(range(250)) * 5
    side = {"key": 7, "a": 1, "b": 2, "first": 20, "low": 0, "high": 100, "group": 40, "hot": False, "twice": False}
    wanted = [side | {"low": 100, "high": 150}, side, side | {"b": 3, "first": 170, "high": 30}, side | {"b": 4, "first": 200, "high": 30, "group": 41}, side | {"high": 150, "twice": True}]
    batch = pa.RecordBatch.from_pylist([{"bytes": text, "wanted": wanted}])
    out = [r for b in suffix_dedup._fetch(400)(iter([batch])) for r in b.to_pylist()]
    assert [(r["key"], r["twice"], r["piece"] == text[low:high]) for r, (low, high) in zip(out, ((20, 599), (200, 629), (20, 569)), strict=True)] == [(40, False, True), (41, False, True), (40, True, True)]
    assert [(m["b"], m["low"], m["count"]) for m in out[0]["members"]] == [(2, 0, 100), (2, 100, 50), (3, 0, 30)]


def test_deduplicated_keeps_columns_and_odd_rows(spark, odd_docs, no_docs):
    out = suffix_dedup.deduplicated(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 11
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text is None and rows[2].text == "" and rows[4].text == "" and rows[6].text == "short text" and rows[6].score == 1
    assert suffix_dedup.deduplicated(no_docs).count() == 0 and suffix_dedup.removals(odd_docs).count() == 11


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 5), (7, 7), (10, 9), (9, 8), (8, 3), (None, 1)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 240)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in (1, 2, 3, 8, 9, 10)) and found[5] == 4 and found[7] == 7 and found[139] == 100 and found[240] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _groups(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(2000)}"
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy).upper() if n % 5 == 0 else " ".join(copy)))
            n += 1
    # A chain whose ends are not alike, and a large group around one text.
    chain = [word() for _ in range(120)]
    for i in range(12):
        rows.append((n, " ".join(chain)))
        chain[9 * i] = word()
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "two words"), (n + 4, "TWO  words")]
    for large in (200, 3):
        monkeypatch.setattr(minhash, "BLOCK_ROWS", large)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
        assert found == _groups(rows, 4, 80)


def test_near_duplicates_in_large_buckets_of_several_components(spark, monkeypatch):
    # More members than the limit share bands; most are too far from the hub and from each other.
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for kind in range(6):
        origin = list(base)
        for k in range(0, 200, 22):
            origin[k] = f"k{kind}x{k}"
        for _ in range(6):
            copy = list(origin)
            copy[rng.randrange(200)] = f"v{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    # One band hash for all: every bucket holds all representatives.
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 5)
    real = minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda docs, size: real(docs, size).withColumn("bands", F.array_repeat(F.lit(7).cast("long"), minhash.BANDS)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert found == _groups(rows, 4, 80)


def test_estimate_is_near_the_similarity(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(900)]
    other = base[:700] + [f"v{rng.randrange(5000)}" for _ in range(200)]
    rows = minhash.signatures(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string"), 4)
    a, b = rows.where("doc_id = 1").select("bits"), rows.where("doc_id = 2").selectExpr("bits as bits_b")
    guess = a.crossJoin(b).select(minhash.estimate(a["bits"], b["bits_b"]).alias("g")).first().g
    assert abs(guess - 697 / 1097) < 0.25


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    found = minhash.near_duplicates(odd_docs)
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9} and rows[None].kept and rows[None].component_id is None and rows[5].component_id == 4 and not rows[5].kept and rows[1].kept and rows[3].n_shingles == 0
    assert minhash.near_duplicates(no_docs).count() == 0


def test_shards_are_even_and_gapless(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows = [(i, "same text for all of these" if i % 3 == 0 else "x" * rng.randint(0, 3000)) for i in range(4000)]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 24).toPandas()
    assert sorted(found.doc_id) == list(range(4000))
    size = found.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() / size.mean() < 1.05 and size.min() / size.mean() > 0.95
    for _, slots in found.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    odd = sharding.shard_by_bytes(odd_docs, 24).toPandas()
    assert len(odd) == 11 and not odd.duplicated(["shard", "slot"]).any() and odd[odd.doc_id == 1]["size"].tolist() == [8]
    assert sharding.shard_by_bytes(no_docs, 24).count() == 0


def test_an_id_with_several_texts_joins_their_components(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (8, c), (8, c), (7, c + " more"), (7, "else entirely here now and then")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == {(5, 3, False), (3, 3, True), (9, 3, False), (8, 7, False), (7, 7, True)}


def test_shards_of_repeated_rows_hold_near_equal_bytes(spark):
    """A third of the rows equal in text and id, a third copies under other ids; each record once, whatever the method."""
    rng = random.Random(8)
    rows = [(7, "the same row " * 4)] * 1500 + [(i, "a copy of one text " * 3) for i in range(1500)] + [(rng.choice((None, i)), rng.choice((None, "", "ü" * rng.randrange(200)))) for i in range(1500)]
    rng.shuffle(rows)
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 24).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == sorted((i if i is not None else -1, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    loads, slots = Counter(), {}
    for r in got:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(loads) == set(range(24)) and max(loads.values()) - min(loads.values()) <= 2 * max(size(t) for _, t in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_small_tables_are_dealt_as_evenly_as_by_trying_all(spark):
    from itertools import product

    rng = random.Random(9)
    for n in (1, 2, 5, 6):
        rows = [(i, "x" * rng.randrange(1, 60)) for i in range(n)]
        loads = Counter()
        for r in sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect():
            loads[r["shard"]] += r["size"]
        sizes = [len(t) + 8 for _, t in rows]
        best = min(max(sum(s for s, w in zip(sizes, where) if w == k) for k in range(3)) for where in product(range(3), repeat=n))
        # Largest first to the emptiest shard is never more than 4/3 of the best.
        assert max(loads.values()) <= best * 4 / 3
