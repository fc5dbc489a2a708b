"""The corpus operators against plain versions, and on awkward rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from compare import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from emporia.llm import (
    decontamination, graph, lm_scoring, mixing, quality, sharding, simhash, token_counts, token_files, toxicity,
    url_filter,
)
from emporia.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, sources=("a",)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty, blank, repeated and very long texts, and columns with clashing names."""
    long = prose(1, 60_000)
    rows = [
        (1, "one two three", "en", "a", 1), (1, "one two three", "en", "a", 1), (1, "another text", "en", None, 1),
        (None, "no id here", "en", "b", 1), (None, None, None, None, None), (2, None, "en", "a", 0),
        (3, "", "en", "b", 0), (4, " \t\n ", "en", "b", 4), (5, long, "en", "a", 1), (6, long + " end", "en", "c", 1),
        (7, "çà \u00a0\u3000 <|endoftext|>  x\n\n y", "fr", "c", 1),
    ]
    names = ("size", "score", "shard", "target", "kept", "n_words", "n_tokens", "fingerprint", "_extra")
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("own") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# The reference results that SQL can say.


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), duck(folder), ORACLES[name]) == []


# 1 SimHash


def plain_classes(prints: dict, distance: int) -> dict:
    """Smallest key reachable by fingerprints within `distance`, by comparing all of them."""
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in prints}


def plain_fingerprint(text: str, width: int = 3) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_against_all_pairs(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    expected = plain_classes(prints, 2)
    got = QUERIES["op1_simhash"](spark, folder).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == expected


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_of_hot_buckets(spark, distance):
    """Hundreds of fingerprints in one bucket: the halfway route must link the same classes as all pairs."""
    draw = random.Random(distance)
    bases = [draw.getrandbits(64) for _ in range(2)]
    prints = {b ^ sum(1 << x for x in draw.sample(range(40, 64), draw.randrange(5))) for b in bases for _ in range(120)}
    prints |= {draw.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    table = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp bigint")
    got = {r.fp % (1 << 64): r.root for r in simhash.classes(table, distance).collect()}
    expected = plain_classes({p: p for p in prints}, distance)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(expected)


def test_every_close_pair_shares_a_block():
    masks = simhash.block_masks(2, 5)
    for a, b in combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)}


def test_simhash_awkward(spark, awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:7]) for r in kept.collect()) == [
        (-1, "no id h"), (1, "another"), (1, "one two"), (2, ""), (5, rows and awkward.where("doc_id = 5").first().text[:7]),
        (7, "çà \u00a0\u3000 <"),
    ]
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


# 2 Quality


def plain_repeat_words(text: str) -> int:
    words = text.split()
    windows = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_repeat_words(spark):
    texts = [prose(s, n, v) for s, n, v in [(1, 50, 3), (2, 200, 6), (3, 9, 1), (4, 300, 400), (5, 3, 1), (6, 2, 1)]]
    got = quality.base_figures(documents(spark, texts)).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: plain_repeat_words(t) for i, t in enumerate(texts)}


def test_costs_are_those_of_the_rules(spark):
    """A rule that takes every text apart costs more than one that compares two numbers."""
    texts = [prose(i, 400) for i in range(400)]
    costs = {m.rule.name: m.seconds for m in quality.measure(documents(spark, texts), quality.default_rules())}
    assert costs["letters"] > 5 * costs["symbols"] and costs["few_words"] > 5 * costs["repeated_words"]


def test_cascade_order_and_result(spark, awkward, empty):
    texts = [prose(i, 80) if i % 3 else prose(i, 80) + " ###" * 30 for i in range(60)]
    docs = documents(spark, texts)
    measured = quality.measure(docs, quality.default_rules())
    order = quality.cascade(measured)
    rates = [m.rejected / m.seconds for m in order]
    assert rates == sorted(rates, reverse=True) and order[0].rule.name in {"symbols", "repeated_words"}
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert kept == {i: bool(i % 3) for i in range(60)}
    backwards = quality.verdict(order[::-1])
    rows = quality.base_figures(docs).select("doc_id", backwards.alias("k")).collect()
    assert {r.doc_id: r.k for r in rows} == kept
    rows = quality.judge(awkward).collect()
    assert len(rows) == awkward.count() and not [r for r in rows if r.kept and r.doc_id not in (5, 6)]
    assert all(isinstance(r.kept, bool) for r in rows)
    assert quality.judge(empty).count() == 0


# 3 Sharding


def check_shards(rows, shards=sharding.SHARDS):
    assert {r.shard for r in rows} <= set(range(shards))
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_are_even_and_gapless(spark):
    copies = ["the same text " * 20] * 300  # a third of the rows in one group
    docs = documents(spark, [prose(i, 20 + i % 90) for i in range(600)] + copies)
    rows = sharding.shard(docs).collect()
    check_shards(rows)
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(r.text.encode()) + 1 and r.text_crc32 == zlib.crc32(r.text.encode())
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.06 * mean and min(sizes.values()) > 0.94 * mean
    assert rows == sharding.shard(docs).collect() or sorted(rows) == sorted(sharding.shard(docs).collect())


def test_small_groups_share_a_shard(spark):
    """Only a group that a shard's end falls on may be cut."""
    docs = documents(spark, [prose(i % 200, 30) for i in range(800)])
    by_text = {}
    for r in sharding.shard(docs).collect():
        by_text.setdefault(r.text, set()).add(r.shard)
    assert max(map(len, by_text.values())) <= 2 and sum(len(s) > 1 for s in by_text.values()) <= 7


@pytest.mark.parametrize("doc_id", [None, 7])
def test_repeated_rows_are_cut_between_shards(spark, doc_id):
    """Rows that nothing tells apart may hold half of the table."""
    rows = [(i, prose(i, 30)) for i in range(600)] + [(doc_id, prose(1000, 30))] * 600
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sharding.shard(docs).collect()
    check_shards(got)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.06 * mean and min(sizes.values()) > 0.94 * mean


def test_overfull_ranges_are_sampled_afresh(spark):
    """Splitters, whatever the sample, end where only single keys are overfull; totals are those of a plain count."""
    draw = random.Random(5)
    table = [(f"{draw.getrandbits(128):032x}", draw.choice([1, 1, 1, 400])) for _ in range(3000)]
    table += [(f"{7:032x}", 9)] * 2000 + [(f"{8:032x}", 50_000)]
    keys = spark.createDataFrame(table, "_key string, _size bigint")
    total = sum(size for _, size in table)
    splitters, totals = sharding.splitters_for(keys, total, 64)
    plain = {}
    for key, size in table:
        plain.setdefault(sum(s <= key for s in splitters), []).append((key, size))
    assert totals == {at: (sum(z for _, z in r), len(r), len({k for k, _ in r}) == 1) for at, r in plain.items()}
    assert all(one or size <= 2 * total / 64 for size, _, one in totals.values())


def test_pieces_against_a_plain_count():
    draw = random.Random(6)
    for shards in (1, 3, 8):
        totals, hot = {}, set()
        for at in range(40):
            n, each = draw.randrange(1, 30), draw.randrange(1, 9)
            totals[at * 3] = (n * each, n, False)
            if draw.random() < 0.3:
                hot.add(at * 3)
        total, before, slots = sum(size for size, _, _ in totals.values()), 0, Counter()
        found = {}
        for at, first, after, s, slot in sharding.pieces_of_ranges(totals, shards, hot):
            for i in range(first, after):
                assert (at, i) not in found
                found[at, i] = (s, slot + i - first)
        for at, (size, n, _) in totals.items():
            for i in range(n):
                each = size // n
                middle = 2 * before + (2 * i * each + each if at in hot else size)
                s = min(shards - 1, middle * shards // (2 * total))
                assert found.pop((at, i)) == (s, slots[s])
                slots[s] += 1
            before += size
        assert not found


def test_sharding_query_against_exact_quantiles(spark, folder):
    """Shards of the query stand in key order, cut where the bytes say, with the rows of each in slots."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = {r.doc_id: r["_key"] for r in sharding.keyed(docs).select("doc_id", "_key").collect()}
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = QUERIES["op3_sharding"](spark, folder).collect()
    check_shards(rows)
    assert sorted(r.doc_id for r in rows) == sorted(text)
    total, before = sum(len(t.encode()) + 1 for t in text.values()), 0
    longest = max(len(t.encode()) for t in text.values())
    for r in sorted(rows, key=lambda r: key[r.doc_id]):
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        middle, slack = (before + r["size"] / 2) * 8 / total, 8 * (longest + 2 * total / sharding.RANGES) / total
        assert middle - slack <= r.shard + 1 and r.shard <= middle + slack
        before += r["size"]
    for s in range(8):
        inside = [(key[r.doc_id][:16], r.slot) for r in rows if r.shard == s]
        assert inside and min(inside)[0] >= max([key[r.doc_id][:16] for r in rows if r.shard < s], default="")


def test_sharding_keeps_columns_named_like_inner_ones(spark):
    inner = ("_at", "_cut", "_home", "_part", "_offset", "_key", "_size", "_row", "_first", "_after", "_slot", "_id", "_crc", "_Rows")
    docs = documents(spark, [prose(i, 30) for i in range(40)] + ["x y"] * 3).withColumns({n: F.concat(F.lit(n), "doc_id") for n in inner})
    rows = sharding.shard(docs)
    assert rows.columns[: len(docs.columns)] == docs.columns
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows.collect() for n in inner)


def test_sharding_awkward(spark, awkward, empty):
    rows = sharding.shard(awkward).collect()
    check_shards(rows)
    assert len(rows) == awkward.count() and {r["size"] for r in rows if not r.text} == {1}
    assert sharding.shard(empty).count() == 0


# 4 Mixing


def plain_targets(sizes: dict, weights=(1, 2, 3), repeats=3) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    order += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    targets, free, rest = {}, set(order), sum(sizes.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > repeats * sizes[s]}
        if not over:
            return targets | share
        for s in over:
            targets[s] = repeats * sizes[s]
            rest -= targets[s]
        free -= over


def plain_seats(targets: dict, seats: int) -> dict:
    got = dict.fromkeys(targets, 0)
    for _ in range(seats):
        best = max(targets, key=lambda r: (targets[r] / (2 * got[r] + 1), -r))
        got[best] += 1
    return got


def test_apportionment_by_highest_quotients(spark):
    draw = random.Random(3)
    claims, expected = [], {}
    for house in range(1, 40):
        targets = {r: draw.choice([1, 5, 7.5, 40, 300]) for r in range(draw.randrange(1, 12))}
        seats = draw.randrange(0, 60)
        claims += [(house, seats, r, float(t)) for r, t in targets.items()]
        expected |= {(house, r): n for r, n in plain_seats(targets, seats).items()}
    table = spark.createDataFrame(claims, "house int, seats_in_house bigint, rank int, target double")
    assert {(r.house, r["rank"]): r.seats for r in mixing.apportion(table).collect()} == expected


def test_mix_meets_targets(spark):
    docs = documents(spark, [prose(i, 5 + i % 60) for i in range(600)], ["hot"] * 8 + ["a", "b", "é", None, "z"])
    rows = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(r.text.split()) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    targets = plain_targets(sizes)
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    for r in rows:
        assert r.target == pytest.approx(targets[r.source])
    for s in sizes:
        assert taken[s] == pytest.approx(targets[s], rel=0.02, abs=3)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())


def test_small_sources_beside_a_hot_one_meet_targets(spark):
    sizes = {"hot": 200_000_000, "s2": 6_000, "s30": 30_000, "x": 1}
    rows = spark.createDataFrame(
        [("hot", i, 50_000) for i in range(4000)] + [("s2", i, 2_000) for i in range(3)]
        + [("s30", i, 3_000) for i in range(10)] + [("x", 0, 1)],
        "source string, doc_id bigint, size bigint",
    )
    mixed = mixing.mix_sized(rows.withColumn("_order", F.xxhash64("source", "doc_id")))
    taken = {r.source: r.taken for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    targets = plain_targets(sizes)
    assert sum(sizes.values()) > 131_072 * 1_000
    for s in sizes:
        assert taken[s] == pytest.approx(targets[s], abs=1)


def test_caps_are_reshared(spark):
    docs = documents(spark, [prose(i, 90) if i % 9 else prose(i, 2) for i in range(90)], ["s0"] + [f"s{i % 3}" for i in range(8)])
    rows = mixing.mix(docs).collect()
    targets = plain_targets({r.source: r.source_size for r in rows})
    assert {r.source: r.target for r in rows} == pytest.approx(targets)


def plain_taken(rows, targets: dict, shards: int, start: dict) -> list:
    """Words taken of each of `rows` (source, size) in ring order, counted block by block and word by word."""
    sizes = Counter()
    for source, size in rows:
        sizes[source] += size
    ranked = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    block = max(1, int(min(t for t in targets.values() if t) // mixing.BLOCKS))
    seats = sum(sizes.values()) // block
    ends = [plain_seats({i: targets[s] for i, s in enumerate(ranked)}, seats * e // shards) for e in range(shards + 1)]
    copies = {}
    for i, source in enumerate(ranked):
        n = sizes[source] // block
        stripes = [range(n * s // shards, n * (s + 1) // shards) for s in range(shards)]
        words = [[w for b in st for w in range(b * block, (b + 1) * block)] for st in stripes]
        words.append(list(range(n * block, sizes[source])))
        given = [min((ends[s + 1][i] - ends[s][i]) * block, 3 * len(words[s])) for s in range(shards)] + [0]
        lack = round(targets[source]) - sum(given)
        for s, inside in enumerate(words):
            change = max(-given[s], min(lack, 3 * len(inside) - given[s]))
            given[s] += change
            lack -= change
        taken = copies[source] = [0] * sizes[source]
        for s, inside in enumerate(words):
            at = 0 if s == shards or not inside else start[source, s] % len(stripes[s]) * block
            for k in range(given[s]):
                taken[inside[(at + k) % len(inside)]] += 1
    before, result = Counter(), []
    for source, size in rows:
        result.append(sum(copies[source][before[source] : before[source] + size]))
        before[source] += size
    return result


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_mix_against_plain_blocks(spark, shards):
    sources = ["hot"] * 5 + ["a", "b", None, "z"]
    docs = documents(spark, [prose(i, i * 7 % 300) if i != 77 else prose(i, 2500) for i in range(180)], sources)
    order = docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(mixing.SEED)).alias("o"))
    place = {r.doc_id: r.o for r in order.collect()}
    keys = spark.createDataFrame([(s, i) for s in {*sources} for i in range(shards)], "source string, shard int")
    start = {(r.source, r.shard): r.h for r in keys.select("*", F.xxhash64("source", "shard", F.lit(mixing.SEED)).alias("h")).collect()}
    rows = sorted(mixing.mix(docs, shards=shards).collect(), key=lambda r: place[r.doc_id])
    targets = {r.source: r.target for r in rows}  # to the last bit: equal quotients go by rank
    sized = [(r.source, r["size"]) for r in rows]
    assert [r.taken for r in rows] == plain_taken(sized, targets, shards, start)


def test_blocks_are_drawn_by_shard(spark):
    """The number of shards decides which blocks are drawn; a stripe gives whole blocks but for what settles the target."""
    docs = documents(spark, [prose(i, 40 + i % 9) for i in range(700)], ["hot"] * 4 + ["a", "b"])
    taken = {n: {r.doc_id: r.taken for r in mixing.mix(docs, shards=n).collect()} for n in (1, 8)}
    assert taken[1] != taken[8] and sum(taken[1].values()) == pytest.approx(sum(taken[8].values()), abs=3)
    targets = mixing.work_table(mixing.source_targets(mixing.sized(docs)))
    block = int(min(r.target for r in targets.collect()) // mixing.BLOCKS)
    drawn = mixing.draws(targets).collect()
    assert len(drawn) == 3 * 9 and block > 1
    for source in "hot", "a", "b":
        stripes = [r for r in drawn if r.source == source]
        assert sum(r.given for r in stripes) == pytest.approx(stripes[0].target, abs=0.5)
        assert sum(abs(r.given - r.quota * block) for r in stripes) <= 2 * block
        assert max(r.quota for r in stripes[:8]) - min(r.quota for r in stripes[:8]) <= 2
        assert len({(r.start - r.first) // block for r in stripes[:8]}) > 1


def test_mixing_keeps_columns_named_like_inner_ones(spark):
    inner = ("_order", "_begin", "_source", "_stripes", "_range", "_group", "_at", "_offset", "_copies", "_copy")
    docs = documents(spark, [prose(i, 30) for i in range(40)]).withColumns({n: F.concat(F.lit(n), "doc_id") for n in inner})
    for rows in (mixing.mix(docs), mixing.repeat_taken(docs)):
        assert rows.columns[: len(docs.columns)] == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows.collect() for n in inner)


def test_shard_quotas_are_whole_and_complete(spark):
    targets = spark.createDataFrame([(0, 10.0), (1, 33.3), (2, 0.0), (3, 900.0)], "rank int, target double")
    rows = mixing.shard_quotas(targets, 1003, 8).collect()
    assert all(r.quota >= 0 for r in rows) and sum(r.quota for r in rows) == 1003
    assert sorted(sum(r.quota for r in rows if r.shard == s) for s in range(8)) == [125] * 5 + [126] * 3


def test_mixing_awkward(spark, awkward, empty):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count() and all(r.taken == 0 for r in rows if not (r.text or "").strip())
    assert mixing.mix(empty).count() == 0
    blank = documents(spark, [None, "", " "])
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0, 0]
    repeated = mixing.repeat_taken(awkward)
    assert repeated.columns == awkward.columns and {r["size"] for r in repeated.collect()} == {"own"}


# 5 Token counts


def test_trie_counts_against_plain_search(spark):
    vocabulary = token_counts.read_vocabulary(token_counts.vocabulary_path())

    def plain(word: str) -> int:
        text, best = token_counts.MARK + word, [(0.0, 0)]
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode())
            options = [(best[-1][0] + token_counts.BYTE_PENALTY * size, best[-1][1] + size)]
            for start in range(end):
                piece = vocabulary.get(text[start:end])
                if piece is not None:
                    options.append((best[start][0] - piece, best[start][1] + 1))
            best.append(min(options))
        return best[-1][1]

    texts = ["The quick brown fox", "naïve café 東京 \U0001f600 \U00013000x", None, "", " \n", "aaaa aaab aaa aa a" * 3, "x" * 500]
    rows = token_counts.count_tokens(documents(spark, texts)).collect()
    for r in rows:
        words = (r.text or "").split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(map(plain, words)))
    assert sum(r.n_bytes for r in rows) > 0


def test_piece_probabilities_add_up():
    vocabulary = token_counts.read_vocabulary(token_counts.vocabulary_path())
    assert np.exp(list(vocabulary.values())).sum() == pytest.approx(1)
    assert -min(vocabulary.values()) < token_counts.BYTE_PENALTY


def test_token_counts_awkward(awkward, empty):
    rows = token_counts.count_tokens(awkward).collect()
    assert len(rows) == awkward.count() and token_counts.count_tokens(empty).count() == 0
    assert {r.n_tokens for r in rows if not (r.text or "").strip()} == {0}


# 6 Decontamination


def test_masks_keep_every_allowed_window():
    for n in range(1, decontamination.WINDOW + 1):
        masks = [m for m in decontamination.masks_for([n]) if (len(decontamination.MASKS) and n < 13) == (m not in decontamination.MASKS)]
        for k in range(decontamination.allowed(n) + 1):
            for changed in combinations(range(n), k):
                assert any(
                    all(o + p not in changed for p in m) for m in masks for o in range(n - m[-1])
                ), (n, changed)


def plain_leaks(docs: dict, items: dict) -> set:
    found = set()
    for d, text in docs.items():
        words = decontamination.WORD.findall((text or "").lower())
        for i, other in items.items():
            item = decontamination.WORD.findall((other or "").lower())
            n = min(13, len(item))
            if n == 0:
                continue
            miss = decontamination.allowed(len(item))
            if any(
                sum(a != b for a, b in zip(item[q : q + n], words[p : p + n])) <= miss
                for q in range(len(item) - n + 1)
                for p in range(len(words) - n + 1)
            ):
                found.add((d, i))
    return found


def test_leaks_against_all_alignments(spark):
    draw = random.Random(4)
    items = {i: prose(900 + i, n, 5000) for i, n in enumerate([40, 25, 13, 12, 9, 8, 6, 5, 30])} | {50: "one two", 51: None}
    docs = {}
    for d in range(80):
        words = prose(d, 60, 5000).split()
        part = (items[draw.randrange(9)]).split()
        for _ in range(draw.randrange(5)):
            part[draw.randrange(len(part))] = "changed"
        at = draw.randrange(50)
        docs[d] = " ".join(words[:at] + part[draw.randrange(3) :] + words[at:]).upper() if d % 4 else " ".join(words)
    rows = decontamination.overlaps(
        documents(spark, docs.values()), spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    ).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == plain_leaks(docs, items)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows}) and all(r.n_matches <= r.n_words for r in rows)


def test_decontamination_awkward(spark, awkward, empty):
    items = spark.createDataFrame([(1, prose(1, 40)), (2, prose(1, 40)), (3, "")], "item_id bigint, text string")
    rows = decontamination.overlaps(awkward, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(5, 1), (6, 1)}
    unnamed = spark.createDataFrame([(None, prose(1, 40)), (None, "another text"), (8, "nothing like it")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.overlaps(awkward, unnamed).collect()) == [(1, None), (5, None), (6, None)]
    own = awkward.withColumn("_key", F.lit("mine"))
    kept = decontamination.decontaminate(own, unnamed)
    assert kept.count() == awkward.count() - 3 and {r["_key"] for r in kept.collect()} == {"mine"}
    clean = decontamination.decontaminate(awkward, items)
    assert clean.columns == awkward.columns and clean.count() == awkward.count() - 2
    assert decontamination.decontaminate(awkward, items.limit(0)).count() == awkward.count()
    assert decontamination.overlaps(empty, items).count() == 0


def test_one_phrase_in_many_items_and_documents(spark):
    """Short items, and a passage that most items and documents share."""
    phrase = prose(77, 20, 5000)
    items = {i: f"{prose(i, 6, 5000)} {phrase}" for i in range(60)} | {100: "rare word", 101: "unheard"}
    docs = [f"{prose(500 + d, 30, 5000)} {phrase if d % 3 else ''} {'Rare, word' if d % 7 == 0 else ''}" for d in range(120)]
    frame = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    rows = decontamination.overlaps(documents(spark, docs), frame).collect()
    expected = {(d, i) for d in range(120) for i in range(60) if d % 3} | {(d, 100) for d in range(0, 120, 7)}
    assert len(rows) == len(expected) and {(r.doc_id, r.item_id) for r in rows} == expected


# 7 Token files


@pytest.mark.parametrize("limit", [4, 6, 16])
def test_code_lengths_are_optimal_within_the_limit(limit):
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 0, 89])
    lengths = token_files.code_lengths(counts, limit)
    used = lengths[counts > 0]
    assert used.max() <= limit and (lengths[counts == 0] == 0).all() and (2.0**-used).sum() <= 1
    if limit == 16:
        import heapq

        heap, cost = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int((lengths * counts).sum()) == cost


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000])
def test_block_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=3000)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=3001))
    payload, marks = token_files.encode_ids(ids, lengths, token_files.canonical_codes(lengths))
    assert (token_files.decode_ids(payload, marks, n, token_files.decoding_table(lengths)) == ids).all()


def expected_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_pieces_encode_like_whole_texts():
    spaces = [" ", "  ", "   ", "\n", "\n ", " \n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", ""]
    draw = random.Random(7)
    words = ["Word", "don't", "x1,", "é", "東京", "<|endoftext|>", "###", "12", "'s", "\U0001f600", "e\u0301"]
    texts = ["".join(draw.choice(words) + draw.choice(spaces) for _ in range(12)) for _ in range(400)]
    texts += [" lead", "trail ", "  ", "a\n", "\n\nb", ""]
    coder = token_files.Encoder(token_files.tokenizer_path())
    flat, sizes = coder.encode(texts)
    got = [flat[end - n : end].tolist() for n, end in zip(sizes, np.cumsum(sizes))]
    assert got == [ids[:-1] for ids in expected_ids(texts)]


def test_token_files_query(spark, folder):
    rows = sorted(QUERIES["op7_token_files"](spark, folder).collect(), key=lambda r: r.doc_id)
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id)
    start = 0
    for r, d, ids in zip(rows, docs, expected_ids([d.text for d in docs]), strict=True):
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_awkward(spark, awkward, empty, tmp_path):
    token_files.write_token_files(awkward, str(tmp_path / "a"))
    rows = sorted(token_files.read_documents(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    docs = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    assert Counter(tuple(r.ids) for r in rows) == Counter(map(tuple, expected_ids([d.text for d in docs])))
    token_files.write_token_files(empty, str(tmp_path / "e"))
    assert token_files.read_documents(spark, str(tmp_path / "e")).count() == 0


# 8 URL filters


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


@pytest.mark.parametrize("partitions", [1, 7])
def test_url_rules_against_plain_search(spark, partitions, monkeypatch):
    draw = random.Random(partitions)
    labels, paths = ["a", "b", "ab", "org", "com", "x-y"], ["/", "/a", "/a/", "/a/b", "/ab", "/b/c/d", ""]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randrange(1, 4)))
    rules = sorted({(host(), draw.choice(paths)): draw.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(*k, v) for k, v in rules]
    urls = [f"http://{host()}{draw.choice(paths)}{draw.choice(['', '?q=/a', '#/a'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "HTTP://A.ORG/a", "x://", "x:///a", "ftp://Ä.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("own"))
    plain = url_filter.sweep
    monkeypatch.setattr(url_filter, "sweep", lambda points, r: plain(points, r, partitions))
    rows = url_filter.judge_urls(pages, spark.createDataFrame(rules, url_filter.RULES_SCHEMA)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        best = plain_rule(r.host, r.path, rules)
        expected = (best[0] + best[1], best[2]) if best else (None, "allow")
        assert len(expected[0] or "") == len(r.rule or "") and (best is None) == (r.rule is None), (r, best)
        if best and sum(len(x[0] + x[1]) == len(r.rule) for x in rules if plain_rule(r.host, r.path, [x])) == 1:
            assert (r.rule, r.verdict) == expected
    none = url_filter.judge_urls(pages, spark.createDataFrame([], url_filter.RULES_SCHEMA)).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, url_filter.RULES_SCHEMA)).count() == 0


# 9 LM scoring


@pytest.mark.parametrize("shared", [True, False])
def test_every_word_counts_in_the_models(spark, shared, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BUCKET_WORDS", 2_000)  # several buckets, hot words and chunks
    monkeypatch.setattr(lm_scoring, "CHUNK_WORDS", 1_500)
    texts = [prose(i, 150, 6_000) + " the of" * 20 + f" rare{i % 30} thing" for i in range(60)] + ["", None]
    target = ["the rare3 thing", "rare3 thing of the"]
    corpus = [(t,) for t in (texts if shared else texts[:40])]
    text = lambda rows: spark.createDataFrame(rows, "text string")
    docs = documents(spark, texts + texts[:1])
    docs = docs.unionByName(docs.where("doc_id = 5"))
    corpus = docs.select("text") if shared else text(corpus)
    rows = lm_scoring.score(docs, text([(t,) for t in target]), None if shared else corpus).collect()
    known = {w for t in [r.text for r in corpus.collect()] + target for w in (t or "").split()}
    assert len(known) > 2_048

    def plain(texts, words=None):
        pairs = Counter()
        for t in texts:
            ids = ["<s>", *(t or "").split()]
            pairs.update(zip(ids, ids[1:]))
        n = sum(pairs.values())
        scale, before, single = (words or n) / n, Counter(), Counter()
        for (v, w), c in pairs.items():
            before[v] += c
            single[w] += c
        smooth = lambda w: (scale * single[w] + 1) / (scale * n + len(known) + 2)
        return lambda v, w: -np.log(
            (scale * pairs[v, w] + lm_scoring.PRIOR * smooth(w)) / (scale * before[v] + lm_scoring.PRIOR)
        )

    losses = plain(target), plain([r.text for r in corpus.collect()], 7)
    assert len(rows) == len(texts) + 2
    for r in rows:
        ids = ["<s>", *(r.text or "").split()]
        expected = [sum(f(v, w) for v, w in zip(ids, ids[1:])) / max(1, len(ids) - 1) for f in losses]
        assert r.n_tokens == len(ids) - 1
        assert [r.target_loss, r.background_loss] == pytest.approx(expected, rel=1e-6)
    ranked = sorted((r for r in rows if r.text), key=lambda r: -r.score)
    assert not shared or {w for r in ranked[:2] for w in r.text.split() if w.startswith("rare")} == {"rare3"}


def test_scores_tell_domains_apart(spark):
    own, other = [prose(i, 80, 50) for i in range(30)], [prose(i, 80, 50).replace("w", "v") for i in range(30)]
    docs = documents(spark, own[15:] + other[15:])
    text = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    rows = lm_scoring.score(docs, text(own[:15]), text(own[:15] + other[:15])).collect()
    assert min(r.score for r in rows if r.text[0] == "w") > max(r.score for r in rows if r.text[0] == "v")


def test_scoring_awkward(awkward, empty):
    rows = lm_scoring.score(awkward, awkward.select("text"), awkward.select("text")).collect()
    assert len(rows) == awkward.count() and all(abs(r.score) < 1e-6 for r in rows)
    assert lm_scoring.score(empty, empty.select("text"), empty.select("text")).count() == 0
    assert lm_scoring.score(awkward, empty.select("text"), awkward.select("text")).count() == awkward.count()


# 10 Toxicity


def labelled(spark, texts, toxic):
    return documents(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")


def test_toxicity_held_out(spark):
    texts = [prose(i, 30) + (" scum" if i % 5 == 0 else " vile" if i % 5 == 1 else "") for i in range(400)]
    docs, labels = labelled(spark, texts, [int(i % 5 < 2) for i in range(400)])
    model = toxicity.train(docs.where("doc_id < 200"), labels)
    rows = toxicity.scored(docs.where("doc_id >= 200"), model).collect()
    assert all(r.predicted == (r.doc_id % 5 < 2) and 0 <= r.score <= 1 for r in rows)


def test_swaps_hold_neutral_mentions_still(spark):
    """Labels that blame a group: without the penalty its name alone raises the score, with it hardly."""
    texts = []
    for i in range(600):
        base = prose(i, 15)
        texts.append(base + (" muslim scum" if i % 4 == 0 else " muslim" if i % 12 == 1 else " christian" if i % 3 == 0 else ""))
    docs, labels = labelled(spark, texts, [int(i % 4 == 0) for i in range(600)])
    probe = documents(spark, [prose(9000 + i, 15) + " muslim" for i in range(20)])
    means = []
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.train(docs, labels, penalty=penalty)
        assert all(r.predicted for r in toxicity.scored(documents(spark, ["pure scum here"]), model).collect())
        gap = model.weights.get("=muslim", 0.0) - model.weights.get("=christian", 0.0)
        means.append((gap, np.mean([r.score for r in toxicity.scored(probe, model).collect()])))
    assert means[1][0] < means[0][0] / 2 and means[1][1] < means[0][1]


def test_toxicity_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op10_toxicity"](spark, folder)
    known = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = known[known.predicted == 1].toxic
    assert right.mean() > 0.95 and right.sum() > 0.7 * known.toxic.sum()


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    rows = toxicity.scored(awkward, toxicity.train(awkward, labels)).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    for docs, known in ((awkward, labels.limit(0)), (empty, labels)):
        assert toxicity.scored(docs, toxicity.train(docs, known)).count() == docs.count()


# Pipeline


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = corpus_pipeline.documents(spark, folder, *corpus_pipeline.COLUMNS)
    tables = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.work_table(stage(spark, docs, folder))
        tables.append(docs.toPandas())
    return tables


def test_stage_columns(stages):
    for table in stages[:-1]:
        assert tuple(table.columns) == corpus_pipeline.COLUMNS


def test_toxic_stage_keeps_clean_documents(stages, spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    clean = set(stages[0].doc_id) - set(labels[labels.toxic == 1].doc_id)
    assert len(clean - set(stages[1].doc_id)) <= 0.02 * len(clean)


def test_duplicate_stage_against_all_pairs(stages):
    before, after = stages[1], stages[2]
    classes = plain_classes({d: plain_fingerprint(t or "") for d, t in zip(before.doc_id, before.text)}, 2)
    assert sorted(after.doc_id) == sorted(set(classes.values()))


def test_benchmark_stage_against_all_alignments(stages, spark, folder):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    before, after = stages[2], stages[3]
    held = set(before.doc_id) - set(after.doc_id)
    for d, text in zip(before.doc_id, before.text):
        if any(t in (text or "") for t in items.values()):
            assert d in held
    sure = plain_leaks({d: t for d, t in zip(before.doc_id, before.text) if d in held}, items)
    assert {d for d, _ in sure} == held


def test_mixing_stage_meets_targets(stages):
    before, after = stages[3], stages[4]
    size = lambda t: len((t or "").split())
    sizes, taken = Counter(), Counter()
    for s, t in zip(before.source, before.text):
        sizes[s] += size(t)
    for s, t in zip(after.source, after.text):
        taken[s] += size(t)
    longest = max(map(size, before.text))
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= 2 * longest
    assert max(Counter(after.doc_id).values()) <= 3


def test_sharding_stage(stages):
    rows = list(stages[5].itertuples())
    check_shards(rows)
    assert sorted(stages[5].doc_id) == sorted(stages[4].doc_id)


def test_run_gives_the_stages_result(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).select("doc_id", "shard", "slot").toPandas()
    pd.testing.assert_frame_equal(
        got.sort_values(["shard", "slot"]).reset_index(drop=True),
        stages[5][["doc_id", "shard", "slot"]].sort_values(["shard", "slot"]).reset_index(drop=True),
    )


def test_pipeline_of_empty_and_awkward_tables(spark, folder, awkward, empty):
    for docs in (empty, awkward.select(*corpus_pipeline.COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.work_table(stage(spark, docs, folder))
        docs.count()


# Columns of the caller that are named like inner ones


@pytest.mark.parametrize(
    "operator",
    [
        lambda docs: quality.judge(docs), lambda docs: simhash.near_duplicates(docs), lambda docs: simhash.keep_one(docs),
        lambda docs: token_counts.count_tokens(docs), lambda docs: lm_scoring.score(docs, docs.select("text")),
        lambda docs: toxicity.scored(docs, toxicity.Model({"=word": 1.0}, -1.0)),
        lambda docs: url_filter.judge_urls(
            docs.withColumn("url", F.lit("http://a.org/x")),
            docs.sparkSession.createDataFrame([("org", "/", "block")], url_filter.RULES_SCHEMA),
        ).drop("url"),
    ],
)
def test_callers_columns_come_back(spark, operator):
    names = ["_fp", "_row", "_key", "_of", "_t", "_words", "_lines", "_again", "_counts", "_at", "_best", "_host", "_path",
             "_labels", "_n", "_order", "_begin", "fp", "root", "first", "key"]
    plain = documents(spark, [prose(1, 60), prose(1, 60), None, "", prose(2, 80)])
    named = plain.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    rows = operator(named).collect()
    assert [c for c in operator(named).columns if c in names] == names
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    without = sorted(map(str, operator(plain).collect()))
    assert sorted(map(str, operator(named).drop(*names).collect())) == without
