"""Each corpus operator against brute force, and on odd rows."""

import ctypes
import hashlib
import re
import string
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import decontamination, html_extract, language_id, linear, lm_scoring, packing, quality_model, quality_rules, sharding, simhash, url_filter
from folioflow.llm.common import table

LONG = " ".join(f"w{i % 977}" for i in range(30000))
TEXTS = [None, "", "   ", "one", "a b c", "A B C D", "the cat sat on the mat " * 40, "the cat sat on the mat " * 40, "12 34 !!", "é" * 5000, LONG, LONG + " tail", "x\x00y\tz\x0bq", "Straße ΑΒΓ 日本語 " * 9, "a" * 20000]
ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, score string, key string, w string, tie string, `group` string, ids string, size string, row string, shard string, items string, words string"


def odd_rows(spark, texts=TEXTS, partitions=3):
    extra = ["x"] * 13
    rows = [(i, t, ("en", "de", None)[i % 3], "s", 0, *extra) for i, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    return spark.createDataFrame(rows, ODD).repartition(partitions)


def none(spark):
    return spark.createDataFrame([], ODD)


def bench_rows(spark):
    return spark.createDataFrame([(1, "the cat sat"), (10, "The CAT, sat!"), (2, None), (3, " ".join(f"w{i}" for i in range(100, 120))), (None, "one")], "item_id long, text string")


def labels_rows(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(15)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


# 3


def brute_overlap(text, items, window=13):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("bound", [1 << 20, 20, 2])
def test_overlaps(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination.find_overlaps, "__defaults__", (*decontamination.find_overlaps.__defaults__[:-1], bound))
    texts = [t for t in TEXTS if t is None or len(t) < 10000] + [" ".join(f"w{i}" for i in range(50, 130)), "W100 w101 w102"]
    items = [(r.item_id, r.text) for r in bench_rows(spark).collect()]
    got = decontamination.overlap_report(odd_rows(spark, texts), bench_rows(spark)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_overlap(texts[r.doc_id], items)
    assert decontamination.overlap_report(none(spark), bench_rows(spark)).count() == 0
    assert decontamination.overlap_report(odd_rows(spark), bench_rows(spark).limit(0)).where("n_hit > 0").count() == 0


def test_removal(spark):
    docs = odd_rows(spark, ["x " * 50 + "the cat sat " + "y " * 50, "the cat sat", "clean, Text"])
    kept = decontamination.remove_documents(docs, bench_rows(spark))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 2]
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench_rows(spark)).collect()}
    assert cut == {0: " ".join(["x"] * 50 + ["y"] * 50), 1: "", 2: "clean, Text"}


def test_span_paths_agree(spark):
    docs = odd_rows(spark, ["the cat sat and one the cat sat", None, LONG])
    spans = lambda b: sorted((r.id, r.n_hit, [(s.start, s.end) for s in r.spans]) for r in decontamination.find_overlaps(docs, bench_rows(spark), broadcast_words=b).collect())
    assert spans(2) == spans(20) == spans(1 << 20)


# 9


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = {}
    for w in wins:
        counts[w] = counts.get(w, 0) + 1
    covered = {p for i, w in enumerate(wins) if counts[w] > 1 for p in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rules(spark):
    texts = [*TEXTS, "l one\nl one\n\n \nl two\n", "| a | # b", " ".join(map(str, range(40))), " ".join(map(str, [*range(40), *range(9)]))]
    got = quality_rules.rules_report(odd_rows(spark, texts)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert quality_rules.rules_report(none(spark)).count() == 0
    docs = odd_rows(spark, ["the cat sat on a mat by the door and it is not for us to say that this was all there is to it", "x"])
    assert quality_rules.keep(docs).columns == docs.columns and [r.doc_id for r in quality_rules.keep(docs).collect()] == [0]


# 6


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), 42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprints_and_groups(spark):
    base = [f"t{i}" for i in range(300)]
    texts = [*TEXTS, " ".join(base), " ".join([*base, "end"]), " ".join(["new", *base[1:]]), " ".join(base[:150] + ["changed"] + base[151:])]
    got = simhash.group_report(odd_rows(spark, texts)).collect()
    assert len(got) == len(texts) + 1
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(list(range(len(texts))), fps)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert simhash.group_report(none(spark)).count() == 0
    kept = simhash.keep_first(odd_rows(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == odd_rows(spark).columns


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_reach_what_all_pairs_reach(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, size=6, dtype=np.uint64)
    fps = set(rng.integers(0, 1 << 62, size=150, dtype=np.uint64).tolist())
    for c in centres.tolist():  # dense groups, chains among them
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, size=rng.integers(0, 7)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(frame, tile=tile)).collect()}
    want = brute_components(signed, fps)
    assert [found.get(x, x) for x in signed] == want


@pytest.mark.parametrize("hot_rows", [3, 100])
def test_hot_keys_change_nothing(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot_rows)
    base = [f"t{i}" for i in range(200)]
    texts = [" ".join(base), *[" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(12)], *["copied text of some words here"] * 9, *[f"alone {i} and {i * 7} is {i * 31} here" for i in range(20)]]
    docs = spark.createDataFrame([*enumerate(texts), *[(5000, "one row that is there again and again")] * 30], "doc_id long, text string").repartition(3)
    want = brute_components(list(range(len(texts))), [brute_fingerprint(t) for t in texts])
    got = simhash.group_report(docs).where("doc_id < 5000").collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want)) and len(got) == len(texts)
    kept = sorted(r.doc_id for r in simhash.keep_first(docs).collect())
    assert kept == sorted({*want, 5000})


@pytest.mark.parametrize("hot_rows", [3, 100])
def test_components_of_chains_and_stars(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot_rows)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (3000, 2999)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(50)} == {1000} and got[3000] == 2999 and len(got) == 201 + 50 + 2


# 4


def check_pieces(rows, tokens, length=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, own in by_doc.items():
        copies = sum(r.start == 0 for r in own)
        want = tokens[doc]
        at = {}
        for r in own:
            assert r.doc_tokens == len(want) and zlib.crc32(want[r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32
            at[r.start] = at.get(r.start, 0) + 1
        n = 0
        for start in sorted(at):
            assert start == n and at[start] == copies
            n += next(r.length for r in own if r.start == start)
        assert n == len(want)
    for own in by_sequence.values():
        n = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == n
            n += r.length
        assert 0 < n <= length
    assert by_doc.keys() == tokens.keys()


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    texts = [*TEXTS, "It's <|endoftext|> we'LL 'START 12.5% ...a,b!!", "A\u030a e\u0301 \xa0x\xa0y ΣΑΣ ǅ İstanbul ½²", "it " * 2047, "it " * 2048]
    tokens = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in enumerate(texts)}
    check_pieces(packing.pack_report(odd_rows(spark, texts)).collect(), tokens)
    small = packing.pack(odd_rows(spark, texts), group=3).withColumn("ids_crc32", F.crc32("ids")).withColumnRenamed("id", "doc_id")
    check_pieces(small.collect(), tokens)
    assert packing.pack_report(none(spark)).count() == 0


def test_padding_is_little(spark, sf_dir):
    p = packing.padding(packing.pack(table(spark, sf_dir, "documents"))).first()
    assert p.padding < 0.05 * p.tokens


def test_equal_rows_spread_over_groups(spark, monkeypatch):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit("the same words in all of them").alias("text")).repartition(4)
    groups = 8
    packed = packing.pack(docs, group=500)
    rows = packed.withColumn("group", F.col("sequence_id") % groups).groupBy("group").count().toPandas()["count"]
    assert len(rows) == groups and rows.sum() == 4000 and rows.max() < 1.3 * 500


def anonymous_mb():
    return int(re.search(r"\nRssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


def test_workers_return_memory_and_hand_on_little(spark, monkeypatch):
    made, kind = [], type(spark.range(0))
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: made.append(f) or own(self, f, schema))
    packing.pack(spark.createDataFrame([(1, "one")], "id long, text string"), id_col="id")
    cut, place = made
    rng = np.random.default_rng(0)
    words = np.array(["".join(w) for w in rng.choice(list(string.ascii_lowercase), (20000, 6))])
    texts = pa.RecordBatch.from_pydict({"id": list(range(4000)), "text": [" ".join(words[rng.integers(0, 20000, 600)]) for _ in range(4000)]})
    assert sum(b.num_rows for b in cut(iter([texts]))) >= 4000
    kept = anonymous_mb()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    assert kept - anonymous_mb() < 16
    n, ids = 5000, rng.integers(0, 49152, (5000, 2048)).astype("<u2")
    whole = pa.RecordBatch.from_pydict({"group": np.zeros(n, dtype=np.int64), "whole": pa.array([True] * n), "id": np.arange(n), "start": np.zeros(n, dtype=np.int64), "length": np.full(n, 2048), "doc_tokens": np.full(n, 2048), "ids": [row.tobytes() for row in ids]})
    at = 0
    for b in place(iter([whole.slice(0, 3000), whole.slice(3000)])):
        assert b.nbytes < 8 << 20
        for i, packed in zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), strict=True):
            assert i == at and packed == ids[i].astype("<u4").tobytes()
            at += 1
    assert at == n


def test_first_fit():
    rng = np.random.default_rng(0)
    for sizes in ([], [2048], sorted(rng.integers(1, 2048, size=300).tolist(), reverse=True)):
        bins, offsets = packing.first_fit_decreasing(sizes)
        room, want = [], []
        for s in sizes:
            b = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [2048] * (b == len(room))
            want.append((b, 2048 - room[b]))
            room[b] -= s
        assert list(zip(bins, offsets, strict=True)) == want


# 5


def test_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = sharding.shard_report(docs).toPandas()
    texts = docs.toPandas().set_index("doc_id").text
    assert got["size"].tolist() == [len(texts[i].encode()) + 16 for i in got.doc_id] and got.text_crc32.tolist() == [zlib.crc32(texts[i].encode()) for i in got.doc_id]
    assert set(got.law) == {"bytes"} and got.shard.between(0, 39).all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    few = sharding.shard(docs, shards=4).toPandas().groupby("shard")["size"].sum()
    assert len(few) == 4 and few.max() - few.min() <= got["size"].max()


def test_shards_of_odd_rows(spark):
    got = sharding.shard_report(odd_rows(spark)).collect()
    assert len(got) == len(TEXTS) + 1 and all(r.grown_shard is None for r in got)
    by = {}
    for r in got:
        t = (TEXTS[r.doc_id] or "").encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_report(none(spark)).count() == 0
    same = spark.createDataFrame([(i, "same text", "en", "hot") for i in range(400)], "doc_id long, text string, lang string, source string")
    sizes = sharding.shard(same, shards=7).groupBy("shard").count().toPandas()["count"]
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 2
    numbered = sharding.shard(same, shards=3, block=10)
    assert sorted((r.shard, r.slot) for r in numbered.collect()) == [(s, i) for s, n in sorted((r.shard, r["count"]) for r in numbered.groupBy("shard").count().collect()) for i in range(n)]


def plain_tree(rows, dims, shards, heavy):
    """Shard of each row: every row sorted at every node, the cut nearest to the wanted bytes."""
    out = {}
    width = lambda own, d: max((r[d] >> 40 for r in own), default=0) - min((r[d] >> 40 for r in own), default=0)
    whole = {d: max(1, width(rows, d)) for d in dims}

    def nearest(own, d, goal):
        best, below = (abs(goal), None), 0
        own = sorted(own, key=lambda r: r[d])
        for i, r in enumerate(own):
            below += r["size"]
            if abs(below - goal) < best[0]:
                best = (abs(below - goal), i)
        return own[best[1]][d] + 1 if best[1] is not None else (own[0][d] if own else 0)

    def grow(own, leaves, first):
        if leaves == 1:
            out.update((r["id"], first) for r in own)
            return
        d = max(dims, key=lambda c: width(own, c) / whole[c])
        goal = sum(r["size"] for r in own) * (leaves // 2) / leaves
        cut = light_cut = nearest(own, d, goal)
        light = [r for r in own if not heavy(r)]
        if len(light) < len(own) and light:
            light_cut = nearest(light, d, max(0, goal - sum(r["size"] for r in own if heavy(r) and r[d] < cut)))
        left = [r for r in own if r[d] < (cut if heavy(r) else light_cut)]
        grow(left, leaves // 2, first)
        grow([r for r in own if not r[d] < (cut if heavy(r) else light_cut)], leaves - leaves // 2, first + leaves // 2)

    grow(rows, shards, 0)
    return out


@pytest.mark.parametrize("shards", [2, 7, 40])
def test_shards_are_those_of_a_plain_tree(spark, sf_dir, shards):
    meta = sharding.cut_lineage(sharding.metadata(table(spark, sf_dir, "documents")))
    total = meta.agg(F.sum("size")).first()[0]
    heavy = lambda r: r["size"] * shards * sharding.HEAVY > total
    rows = [r.asDict() for r in meta.collect()]
    _, got = sharding.grow(meta.withColumn("heavy", F.col("size") * (shards * sharding.HEAVY) > total), shards)
    want = plain_tree(rows, ["d_0", "d_1", "d_size"], shards, heavy)
    assert {r.id: r.shard for r in got.collect()} == want


def test_dimensions_are_metadata(spark):
    docs = spark.createDataFrame([(i, "x" * (1 << i % 5), s, None) for i, s in enumerate(["src1", "src10", "src2", "src", None, "srz", "src1é", "src1"] * 3)], "doc_id long, text string, source string, lang string")
    rows = sharding.metadata(docs).join(docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("s")), "id").collect()
    by = {r.s: r.d_0 >> 40 for r in rows}
    assert [by[s] for s in sorted(by)] == sorted(by.values()) and len(set(by.values())) == len(by) and max(by.values()) == (1 << 22) - 1
    assert {r.d_1 >> 40 for r in rows} == {0} and len({r.row for r in rows}) == len(rows)
    assert sorted(rows, key=lambda r: r["size"])[0].d_size >> 40 == min(r.d_size >> 40 for r in rows)


def test_equal_rows_are_cut_apart(spark, tmp_path):
    docs = spark.createDataFrame([(7, "the same text of all of them " * 20, "hot", "en", "a", i) for i in range(3000)] + [(i, "another text " * (i % 90), "s", "de", "b", i) for i in range(1000, 2000)], "doc_id long, text string, source string, lang string, slot string, text_crc32 int")
    sizes = sharding.shard(docs, shards=4).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(sizes) == 4 and sizes.max() - sizes.min() < 0.01 * sizes.max()
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 4000 and written.select(docs.columns).exceptAll(docs).count() == 0
    bytes_of = written.groupBy("__shard").agg(F.sum(F.octet_length("text") + 16).alias("n")).toPandas().n
    assert bytes_of.max() - bytes_of.min() < 0.01 * bytes_of.max()


def test_written_shards(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).select(docs.columns).exceptAll(docs).count() == 0


# 1


def test_segmentations_are_summed():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba"]
    rng = np.random.default_rng(1)
    weights = np.log(rng.dirichlet(np.ones(len(pieces) + 1), size=2).T)
    model = language_id.Model(["x", "y"], pieces, weights)

    def total(word, lang):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                piece = word[start:end]
                if piece in pieces:
                    sums[end] += sums[start] * np.exp(weights[pieces.index(piece), lang])
                elif end - start == 1:
                    sums[end] += sums[start] * np.exp(weights[-1, lang])
        return np.log(sums[-1])

    words = ["ab", "abab", "q", "aqb", "bababab", "a" * 60]
    got = model.lattice(words).forward(weights)
    assert np.allclose(got, [[total("▁" + w, lang) for lang in (0, 1)] for w in words])
    used = model.lattice(["ab"]).expected(weights[:, :1], np.array([1.0]))
    assert np.isclose(used[pieces.index("b")] + used[pieces.index("ab")] + used[pieces.index("▁ab")], 1.0)


def test_fitting_by_hand(spark):
    """One round of expectation maximisation over every segmentation, one by one."""
    docs = spark.createDataFrame([(1, "The cat, the Hat 42!", "en"), (2, "die Katze", "de"), (3, "x" * 150 + " the", "en")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, rounds=1)
    place = {p: i for i, p in enumerate(model.pieces)}
    words = {"de": ["die", "katze"], "en": ["the", "cat", "the", "hat", "the", "x" * 64, "x" * 64, "x" * 22]}
    mass = np.zeros((len(place), 2))
    for i, lang in enumerate(model.languages):
        for word in words[lang]:
            line, even = "▁" + word, 1 / len(place)
            n = len(line)
            options = [[(s, place.get(line[s:e])) for s in range(e) if line[s:e] in place or e - s == 1] for e in range(n + 1)]
            weight = lambda p: even if p is not None else np.exp(-np.log(len(place)))
            front = [1.0] + [0.0] * n
            for e in range(1, n + 1):
                front[e] = sum(front[s] * weight(p) for s, p in options[e])
            back = [0.0] * n + [1.0]
            for e in range(n, 0, -1):
                for s, p in options[e]:
                    back[s] += back[e] * weight(p)
            for e in range(1, n + 1):
                for s, p in options[e]:
                    if p is not None:
                        mass[p, i] += front[s] * weight(p) * back[e] / front[n]
    own = mass / mass.sum(axis=0)
    want = np.log(own * 0.99 + (own.mean(axis=1, keepdims=True) * 0.9 + 0.1 / len(place)) * 0.01)
    assert model.languages == ["de", "en"] and np.allclose(model.weights[:-1], want, atol=1e-6)


def test_remembered_words(monkeypatch):
    model = language_id.Model(["a", "b"], ["▁", "a", "b", "ab"], np.log(np.random.default_rng(2).dirichlet(np.ones(5), size=2).T), remembered=40)
    texts = [" ".join(f"a{'b' * (i % 7)}a{i} ab!" for i in range(lo, lo + 30)) for lo in range(0, 3000, 30)] + ["字" * 200 + "。", "!!"]
    got = model.predict(texts)
    fresh = [language_id.Model(*model.__getstate__()).predict([t]) for t in texts]
    assert got[0] == [f[0][0] for f in fresh] and np.allclose(got[1], [f[1][0] for f in fresh])
    assert language_id.words_of("(" + "a" * 130 + ")") == ["a" * 64, "a" * 64, "aa"] and language_id.words_of("A b") == ["a", "b"]


def test_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = language_id.language_report(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5).eq(0).all()


def test_languages_of_odd_rows(spark, sf_dir):
    docs = odd_rows(spark)
    got = {r.doc_id: r for r in language_id.language_report(docs).collect()}
    assert [i for i, r in got.items() if r.lang_pred == "und"] and all(got[i].lang_pred == "und" and got[i].score == 0 for i, t in enumerate(TEXTS) if not language_id.has_letter(t))
    assert all(got[i].lang_pred in ("en", "de") for i, t in enumerate(TEXTS) if language_id.has_letter(t))
    assert language_id.language_report(none(spark)).count() == 0
    unlearned = language_id.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlearned} == {"und"} and len(unlearned) == len(TEXTS) + 1
    blind = language_id.identify(docs.drop("lang", "source"), language_id.fit(language_id.learnable(docs)))
    assert {r.id: r.lang_pred for r in blind.collect()} == {i: r.lang_pred for i, r in got.items()}


# 2


def test_quality_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality_model.quality_report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held[held.quality == 1].predicted.mean() > 0.98 and held[held.quality == 0].predicted.mean() < 0.15
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and got.score.between(0, 1).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()


def brute_word(word):
    front = re.match(r"[^\W_]|", word) and re.match(r"(?:(?![^\W_]).)*", word, re.S)[0]
    rest = word[len(front) :]
    core = rest[: max((i + 1 for i, c in enumerate(rest) if re.match(r"[^\W_]", c)), default=0)]
    case = 0 if not core else 1 if len(core) > 1 and core.isupper() else 2 if core[0].isupper() else 3

    def h(t):
        out = 0
        for c in reversed(t.encode()):
            out = (out * 0x100000001B3 + c + 1) % (1 << 64)
        return out

    return h(core.lower()), ((3 * h(front) + 5 * h(rest[len(core) :])) * 4 + case) % (1 << 64)


def brute_features(text, bits=18):
    """Feature and value, word by word."""
    words = [brute_word(w) for w in re.findall(r"\S+", text or "")]
    one = lambda a, b, kind: int(linear.mix(np.array([a], dtype=np.uint64), np.array([b], dtype=np.uint64), kind, bits)[0])
    counts = {}
    found = [one(c, 0, 1) for c, _ in words] + [one(m, 0, 2) for _, m in words]
    for (c, m), (d, n) in zip(words, words[1:], strict=False):
        found += [one(c, d, 3), one(m, n, 4)] + ([one(1, 0, 5)] if c == d else [])
    for f in found:
        counts[f] = counts.get(f, 0) + 1
    length = sum(n * n for n in counts.values()) ** 0.5
    return {f: n / length for f, n in counts.items()}


def test_features_by_hand():
    texts = ["The cat, THE cat! the the", None, "", " \n ", "(A) b...", LONG[:2000], "字" * 300 + " 字。 字", "x" * 100 + " " + "x" * 101, "'tis _a_ Ab AB éÉ --- -"]
    rows = quality_model.Features().of(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        at = slice(rows.bounds[i], rows.bounds[i + 1])
        want = brute_features(t)
        assert rows.at[at].tolist() == sorted(want) and np.allclose(rows.x[at], [want[f] for f in sorted(want)])


def test_training_by_hand():
    rng = np.random.default_rng(5)
    data = [({int(f): float(v) for f, v in zip(rng.choice(16, 4, replace=False), rng.random(4), strict=True)}, int(rng.integers(0, 2))) for _ in range(60)]
    learner = linear.Ftrl(4, 0.25)
    z, n, alpha, beta, l1, l2 = [0.0] * 16, [0.0] * 16, 0.3, 1.0, 0.05, 0.5
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else -(z[f] - (l1 if z[f] > 0 else -l1)) / ((beta + n[f] ** 0.5) / alpha + l2)
    for x, y in data:
        own = {f: weight(f) for f in x}
        slip = 1 / (1 + np.exp(-sum(own[f] * v for f, v in x.items()) - 0.25)) - y
        for f, v in x.items():
            g = slip * v
            z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * own[f]
            n[f] += g * g
        learner.learn(np.array(list(x)), np.array(list(x.values())), y)
    weights, bias = learner.weights()
    assert np.allclose(weights, [weight(f) for f in range(16)], atol=1e-6) and bias == 0.25
    assert np.isclose(linear.log_odds([1, 1, 0]), np.log(3 / 2)) and linear.log_odds([]) == 0


def test_training_is_bounded(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    full, few, none_at_all = (quality_model.fit(docs, labels, entries=n) for n in (1 << 30, 20_000, 0))
    assert few.weights.any() and not np.array_equal(few.weights, full.weights)
    assert not none_at_all.weights.any() and none_at_all.bias == 0


def test_long_words_count_to_their_end():
    long = "字" * 5000
    core, mark = quality_model.word_hashes(pa.array([long + "a", long + "b", long + "。", long, "-" * 5000 + "a", "a", "-" * 5000, "-" * 4999]))
    assert core[0] != core[1] and core[2] == core[3] and mark[2] != mark[3] and core[4] == core[5] and mark[4] != mark[5] and mark[6] != mark[7]


def test_quality_of_odd_rows(spark):
    got = quality_model.quality_report(odd_rows(spark), labels_rows(spark)).collect()
    assert len(got) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_model.quality_report(odd_rows(spark), labels_rows(spark).limit(0)).collect()} == {0.5}
    assert quality_model.quality_report(none(spark), labels_rows(spark)).count() == 0


# 7


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    best = None
    for rule, verdict in url_filter.RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def brute_url_score(host, path, model):
    weights, bias, bits = model
    counts = {}
    for kind, text in ((1, f"^{host}$"), (2, f"^{path}$")):
        for n in (3, 4, 5):
            for i in range(len(text) - n + 1):
                h = 0
                for c in text[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
                at = int(linear.mix(np.array([h], dtype=np.uint64), n, kind, bits)[0])
                counts[at] = counts.get(at, 0) + 1
    length = sum(c * c for c in counts.values()) ** 0.5
    return 1 / (1 + np.exp(-(sum(float(weights[at]) * c / length for at, c in counts.items()) + bias)))


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/71?x#y", "http://com/en/", "http://example.com/en/6", "http://notexample.com/en/7", "https://a.example.net/de/81", "https://example.net/de/9",
    "https://x.org/es/1", "https://x.org/ES/1", "https://x.org?q=/es/", "https://x.org#/es/", "https://example.com:80/en/7", "a://b://c/d", "https://casino-royal.top/buy/viagra-cheap", "https://É.example.com/en/x", "http://h/" + "p" * 20000,
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", "s") for i, u in enumerate(URLS)] + [(1, "", "h", "p", "s")], "page_id long, url string, host string, path string, score string")
    got = url_filter.url_report(pages).collect()
    assert len(got) == len(URLS) + 1
    model = url_filter.fit()
    for r in got:
        host, path, rule = brute_url(URLS[r.page_id])
        own = "block" if brute_url_score(host, path, model) >= 0.5 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[0], rule[1] if rule else own)
    assert {r.page_id: r.verdict for r in got}[17] == "block" and url_filter.url_report(pages.limit(0)).count() == 0


def test_urls_that_were_not_learned():
    found = url_filter.cross_validated()
    assert found["accuracy"] > 0.8 and found["precision"] > 0.9 and found["recall"] > 0.7
    hosts = {url_filter.split_url(u)[0] for u, _ in url_filter.LABELLED}
    assert len(hosts) > 290 and not any("example" in h for h in hosts) and "" not in hosts
    model = url_filter.fit()
    block = ["m.casino-win.example.com", "cheap-pills.example.net", "www.free-bets.example.org", "spam-farm.example.com", "best-poker-slots.example", "xxx-porn.example"]
    allow = ["example.com", "www.example.org", "botany.example.net", "school-library.example.org", "blog.gardening.example.com", ""]
    score = lambda hosts: url_filter.model_scores(pa.array(hosts), pa.array(["/en/12"] * len(hosts)), model)
    assert (score(block) >= url_filter.THRESHOLD).all() and (score(allow) < url_filter.THRESHOLD).all()


def test_equally_long_rules(spark):
    pages = spark.createDataFrame([("http://a.com/en/1",)], "url string").select(F.lit(1).alias("page_id"), "url")
    for rules in ((("com/en/", "block"), ("a.com/e", "allow")), (("a.com/e", "allow"), ("com/en/", "block"))):
        assert url_filter.judge(pages, rules=rules).first().rule == rules[0][0]


# 8


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="top"><p>Site, name. here.</p></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div id="sidebar"><p>Side, text. and more, yes. And longer than the rest, by far; so it is.</p></div><div class="cookie-notice"><p>We, use. cookies.</p></div><div class="main-content"><article><header><h1>Head &amp; line</h1></header>
<p>One&nbsp;two<br>three,   <i>it</i>alic.<p>Second &lt;b&gt; para.<ul><li>item, one</li><li>item two.</ul><div class="ad">Buy, now.</div><form><label>Name</label></form><script>if (a<b) {"</p>"}</script><!-- <p>no</p> --><blockquote>Said, once.</blockquote></article>
<section id="comments"><p>Reader, words. more, words. and again, words.</p></section></div><footer>&copy; foot, er.</footer></body></html>"""


def test_extraction(spark):
    want = "Head & line\n\nOne two three, italic.\n\nSecond <b> para.\n\nitem, one\n\nitem two.\n\nSaid, once."
    pages = spark.createDataFrame([(0, "u", PAGE, "x"), (1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>only", "x"), (4, "u", "plain text", "x"), (5, "u", "<script>x", "x"), (6, "u", "<div>" * 500 + "deep, text.", "x"), (7, "u", "<p>" + "long, text. " * 20000, "x"), (7, "u", "<p>" + "long, text. " * 20000, "x"), (8, "u", "a < b & c", "x")], "page_id long, url string, html string, text string")
    got = html_extract.extraction_report(pages).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 10 and all(r.n_chars == len(r.text) for r in got)
    assert by[0] == want and by[1] == by[2] == by[5] == "" and by[3] == "only" and by[4] == "plain text" and by[6] == "deep, text." and by[7] == ("long, text. " * 20000).strip() and by[8] == "a < b & c"
    assert html_extract.extraction_report(pages.limit(0)).count() == 0


def test_short_and_linked_parts_of_the_article_stay():
    paragraph = "A sentence of the article, with signs. " * 13
    cells = "".join(f"<tr><td>cell {i:03d}</td></tr>" for i in range(30))
    links = "".join(f'<li><a href="/{i}">Reference {i}</a></li>' for i in range(10))
    inner = f"<h1>T</h1>{f'<h2><a href=x>Part</a></h2><p>{paragraph}</p>' * 5}<table><tbody>{cells}</tbody></table><ul>{links}</ul>"
    want = ["T", *["Part", paragraph.strip()] * 5, *[f"cell {i:03d}" for i in range(30)], *[f"Reference {i}" for i in range(10)]]
    menu = "<div><ul><li><a href=y>Elsewhere</a></li></ul></div>"
    for page in (f"<html><body>{menu}<article>{inner}</article>{menu}</body></html>", f"<body>{menu}<main><div>{inner}</div></main></body>", f"<body>{menu}<div><div>{inner}</div></div></body>", f"<body>{inner}</body>", inner):
        assert html_extract.extract_text(page).split("\n\n") == want
    lone = f"<h2><a href=x>Part</a></h2><p>{paragraph}</p><ul>{links}</ul>"
    assert html_extract.extract_text(f"<body><div>{lone}</div></body>").split("\n\n") == ["Part", paragraph.strip(), *want[-10:]]


def test_names_of_parts():
    said = "Words of it, said. " * 9
    kept = ['section id="discussion"', 'h2 id="search-algorithms"', 'h2 id="search"', 'p class="notice"', 'div id="copyright-law"', 'h2 id="share-prices"', 'div class="entry-header"', 'header class="entry-header"', 'div class="post-content"', 'div id="social-history"', 'section id="social-media"', 'div id="content-sidebar-wrap"']
    gone = ['div class="post-comments"', 'div class="cookie-notice"', 'div class="entry-share-buttons"', 'div id="sidebar"', 'section id="comments"', 'div class="content-sidebar"', 'div id="div-gpt-ad-12"', 'div class="siteFooter"', 'div class="ad"', 'ul class="nav main-menu"', 'div class="post-related"']
    for part in kept + gone:
        page = f"<body><article><p>{said}</p><{part}>Part, of it.</{part.split()[0]}><p>{said}</p></article></body>"
        assert ("Part, of it." in html_extract.extract_text(page)) == (part in kept), part
    code = '<pre><code>x = 1 <span class="token comment"># one</span></code></pre>'
    assert "# one" in html_extract.extract_text(f"<article><p>{said}</p>{code}</article>")


def brute_ratios(page):
    """Every path against every other one, by the steps between them."""
    trail = lambda p: [p] + (trail(page.path_parents[p]) if p else [])
    sums = {}
    for path, _, text, linked in page.blocks:
        own = sums.setdefault(path, [0, 0, 0, 0])
        for i, x in enumerate((1, len(text), len(re.findall(r"[.,;:!?…。，；：！？、]", text)), linked)):
            own[i] += x
    lower = lambda p: 0.01 if page.lowered[p] else 1
    raw = {p: ((size / n) * (1 + marks / n)) ** 0.5 * (1 - links / size) ** 2 * lower(p) for p, (n, size, marks, links) in sums.items()}
    out = {}
    for p in raw:
        top = below = 0
        for q in raw:
            steps = len(set(trail(p)) ^ set(trail(q)))
            weight = html_extract.SPREAD**steps * sums[q][0] ** 0.5
            top, below = top + weight * raw[q], below + weight
        out[p] = top / below * (1 - sums[p][3] / sums[p][1]) * lower(p)
    return out


def article_of(page):
    import html

    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return [b for b in blocks if b]


def test_ratios_by_hand(spark, sf_dir):
    pages = [PAGE, "<div>a, b.<div>c<ul><li>d.<li><a>e</a></ul></div></div><p>f, g. h!</p>", "x", *[r.html for r in table(spark, sf_dir, "pages").limit(5).collect()]]
    for page in pages:
        for lists in (True, False):
            read = html_extract.Page(page, lists)
            got = html_extract.path_ratios(read)
            want = brute_ratios(read)
            assert np.allclose([got[p] for p in want], list(want.values())) and not any(r for p, r in enumerate(got) if p not in want)


def test_the_ratios_select(spark, sf_dir):
    pages = [r.html for r in table(spark, sf_dir, "pages").collect()]
    right = found = wanted = 0
    for page in pages:
        want = article_of(page)
        assert html_extract.extract_text(page).split("\n\n") == want and html_extract.extract_text(page, threshold=0).split("\n\n") != want
        got = html_extract.extract_text(page, lists=False).split("\n\n")  # by the ratios alone
        right, found, wanted = right + len(set(got) & set(want)), found + len(set(got)), wanted + len(set(want))
    assert right == wanted and right > 0.8 * found


def test_deep_pages_take_linear_time():
    import time

    deep = lambda n: "".join(f"<div>text, {i}." for i in range(n)) + "<i><p>a" * 50 + "</b>" * n
    began = time.perf_counter()
    assert len(html_extract.extract_text(deep(20_000)).split("\n\n")) == 20_050
    assert time.perf_counter() - began < 10


def test_extraction_of_the_tables(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").toPandas()
    got = html_extract.extraction_report(table(spark, sf_dir, "pages")).toPandas().set_index("page_id").text
    for p in pages.itertuples():
        assert got[p.page_id].split("\n\n") == article_of(p.html)


# 10


def brute_losses(pieces, texts, marks):
    size = pieces.size
    keys, bounds = pieces.bigrams(pa.array(texts, pa.string()))
    grams = [keys[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    model = pieces.model
    for text, own in zip(texts, grams, strict=True):  # the words one by one
        ids = []
        for w in (text or "").encode().split():
            core = w.decode().rstrip(string.punctuation)
            for unit in (core, w.decode()[len(core) :]) if core else (w.decode(),):
                ids += model.encode(unit) if unit else []
        assert own == [(ids[i - 1] if i else size) * (size + 1) + x for i, x in enumerate(ids)]
    out = []
    for chosen in ([g for g, m in zip(grams, marks, strict=True) if m], grams):
        pair, before, kinds, own = {}, {}, {}, {}
        for k in (k for g in chosen for k in g):
            pair[k] = pair.get(k, 0) + 1
        for k, n in pair.items():
            a, b = divmod(k, size + 1)
            before[a], kinds[a], own[b] = before.get(a, 0) + n, kinds.get(a, 0) + 1, own.get(b, 0) + n
        total = sum(own.values())

        def loss(k, pair=pair, before=before, kinds=kinds, own=own, total=total):
            a, b = divmod(k, size + 1)
            base = own.get(b, 0) / total * 0.99 + 0.01 / size if total else 1 / size
            p = max(pair.get(k, 0) - 0.75, 0) / before[a] + 0.75 * kinds[a] / before[a] * base if before.get(a) else base
            return -np.log(p)

        out.append([float(np.mean([loss(k) for k in g])) if g else 0.0 for g in grams])
    every = [k for g in grams for k in g]
    times = {}
    for k in every:
        times[k] = times.get(k, 0) + 1
    once = {k for k, x in times.items() if x == 1}
    return [len(g) for g in grams], out[0], out[1], [sum(k in once for k in g) / max(1, len(g)) for g in grams]


@pytest.mark.parametrize("bound", [1 << 20, 300, 0])
@pytest.mark.parametrize("share", [2, 10**9])
def test_cross_entropy(spark, bound, share):
    marks = [i % share == 1 for i in range(len(TEXTS))]
    docs = odd_rows(spark).withColumn("target", F.when(F.col("doc_id") % share == 1, True))
    got = lm_scoring.score(docs, broadcast_bigrams=bound).collect()
    assert len(got) == len(TEXTS) + 1
    n, target, background, novelty = brute_losses(lm_scoring.Pieces(lm_scoring.vocabulary_bytes()), [*TEXTS, TEXTS[-1]], [*marks, marks[-1]])
    for r in got:
        assert r.n_tokens == n[r.id] and np.isclose(r.target_loss, target[r.id], rtol=1e-4) and np.isclose(r.background_loss, background[r.id], rtol=1e-4) and np.isclose(r.score, target[r.id] - background[r.id], atol=1e-3) and np.isclose(r.novelty, novelty[r.id])


def test_language_models_prefer_their_own(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = lm_scoring.lm_report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got[got.quality == 1].score.mean() < got[got.quality == 0].score.mean()
    assert lm_scoring.lm_report(none(spark), labels).count() == 0


# SQL


def test_sql_agrees(spark, sf_dir):
    from folioflow.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf_dir).toPandas()
        want = con.execute(sql).fetchdf()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(tuple, got[cols].astype(str).to_numpy())) == sorted(map(tuple, want[cols].astype(str).to_numpy()))


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "same text here"), (None, "same text here"), (None, None), (1, "other words entirely"), (1, "other words entirely")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_first(docs).collect()) == [(0, ""), (0, "same text here"), (1, "other words entirely")]
    assert simhash.group_report(docs).count() == 5 and packing.pack_report(docs).count() == 5 and sharding.shard_report(docs).count() == 5
    for held in (language_id.language_report(docs.withColumn("lang", F.lit("en"))), quality_model.quality_report(docs, labels_rows(spark))):
        assert [r.held_out for r in held.where("doc_id is null").collect()] == [False] * 3
    assert language_id.language_report(docs.withColumn("lang", F.lit("en"))).count() == 5 and quality_model.quality_report(docs, labels_rows(spark)).count() == 5
    assert decontamination.overlap_report(docs, bench_rows(spark)).count() == 5 and lm_scoring.lm_report(docs, labels_rows(spark)).count() == 5


def test_one_row_of_each_group_stays(spark):
    base = [f"t{i}" for i in range(300)]
    a, near, other = " ".join(base), " ".join(base).upper(), "other words entirely"
    docs = spark.createDataFrame([(None, a), (None, near), (None, near), (None, other), (None, other + " x"), (7, other), (7, a), (8, near), (8, "alone on its own here"), (None, "nobody knows this one"), (None, "nobody knows this one")], "doc_id long, text string")
    prints = {t: brute_fingerprint(t) for t in {r.text for r in docs.collect()}}
    group = dict(zip(prints, brute_components(list(range(len(prints))), list(prints.values())), strict=True))
    rows = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    assert group[a] == group[near] and sorted(group[t] for _, t in rows) == sorted(set(group.values()))
    assert {(7, other), (7, a), (8, "alone on its own here"), (None, "nobody knows this one")} <= set(rows)


def test_memory_of_words():
    from folioflow.llm.common import Remembered

    held = Remembered(6)
    for i in range(20):
        assert held.take({"hot"}) in ({}, {"hot": 1})
        held.put({"hot": 1, i: i})
    assert held.take({"hot", 19, 0}) == {"hot": 1, 19: 19} and len(held.new) + len(held.old) <= 7
