"""The corpus operators against brute force, with nulls, empty tables, repeats and clashing columns."""

import itertools
import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mailquarry.llm import components, decontaminate, language, licenses, lines, packing, quality_rules, records, simhash, site_quality, toxicity
from mailquarry.llm.common import hash_filter, perhaps_in
from mailquarry.llm.registry import tokenizer_file
from mailquarry.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, root string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "x"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, copies and near copies; three columns clash."""
    rng = random.Random(5)
    rows = [[i, sentence(rng, rng.randint(5, 120)), rng.choice(["en", "fr", None]), f"s{i % 3}", 1, 0.5, 7, "r"] for i in range(60)]
    rows += [[100, None, None, None, None, None, None, None], [101, "", "en", "s0", 0, None, 0, ""], [102, " \n\t ", "en", "s0", 3, 0.0, 0, "x"]]
    rows += [[103, sentence(rng, 20_000), "en", "s1", 0, 0.0, 0, "x"], [None, rows[3][1], "en", "s1", 0, 0.0, 0, "x"], [None, None, "en", "s1", 0, 0.0, 0, "x"]]
    rows += [rows[5], rows[5], [200, rows[7][1], "en", "s2", 0, 0.0, 0, "x"], [201, rows[103 - 40][1] + " tail", "en", "s2", 0, 0.0, 0, "x"]]
    rows += [[202, "same line of text here 12 now\n" + sentence(rng, 9), "fr", "s2", 0, 0.0, 0, "x"], [203, "same line of text here 9 now\nother", "fr", "s2", 0, 0.0, 0, "x"]]
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_hash_filter_passes_every_key(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    got = perhaps_in(spark.range(3000).withColumn("k", F.xxhash64("id")), F.col("k"), hash_filter(keys, F.col("k"), 20), 20)
    ids = {r.id for r in got.collect()}
    assert ids >= set(range(0, 3000, 3)) and len(ids) < 1100


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, docs, none):
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    rows = rows_of(docs)
    prints = [brute_print(t) for _, t in rows]
    assert sorted((str(r.doc_id), r.fingerprint % 2**64) for r in got) == sorted((str(i), p) for (i, _), p in zip(rows, prints))
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            group[i] = min(group[j] for j, b in enumerate(prints) if bin(a ^ b).count("1") <= 2)
    least = defaultdict(lambda: None)
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = i if least[g] is None else min(least[g], i)
    want = sorted((str(i), str(least[g])) for g, (i, _) in zip(group, rows))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(none).count() == 0 and simhash.first_of_each(none).count() == 0


def test_links_reach_all_pairs_and_crowded_keys(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)]
    prints = sorted({x - 2**64 if x >= 2**63 else x for x in base + near})
    rows = spark.createDataFrame([(x,) for x in prints], "fp long")

    def roots(pairs):
        return {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}

    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if bin((a ^ b) % 2**64).count("1") <= 2]
    want = roots(pairs)
    for most in (64, 3):
        found = [(r.a, r.b) for r in simhash.links(rows, most).collect()]
        assert all(bin((a ^ b) % 2**64).count("1") <= 2 for a, b in found)
        assert roots(found) == want


def test_golay_keys_shared_at_one_bit():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 500)
    for bit in range(23):
        a, b = simhash.syndromes(words), simhash.syndromes(words ^ (1 << bit))
        for w, x, y in zip(words, a, b):
            own = {int(w ^ p) for p in simhash.PATTERNS[x][: simhash.PATTERN_COUNT[x]]}
            assert own & {int(w ^ (1 << bit) ^ p) for p in simhash.PATTERNS[y][: simhash.PATTERN_COUNT[y]]}


def test_lines(docs, none):
    got = {r.doc_id: r for r in lines.dedup_lines(docs.where("doc_id >= 100")).collect()}
    assert got[100].text is None and got[100].n_lines == 0
    assert got[101].text == "" and got[202].n_dropped == 0 and got[203].text == "other"
    every = lines.dedup_lines(docs)
    assert every.count() == docs.count() and set(docs.columns) < set(every.columns)
    copies = every.where("doc_id = 200 OR doc_id IS NULL").select("text").collect()
    assert sorted(str(r.text) for r in copies) == ["", "", "None"]
    assert lines.dedup_lines(none).count() == 0


def test_line_template_with_a_variable_word(spark):
    names = ["ann", "bob", "cy", "dee", "ed", "flo", "gus", "hal", "ida", "jo", "kit", "lee"]
    rows = [(i, f"the user was greeted by {n} on the first day here\nbody {n} {i} is different in every text {n}{i}") for i, n in enumerate(names)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.n_dropped for r in got.collect())[0] == 0 and got.where("n_dropped >= 1").count() == 11


@pytest.mark.parametrize("others", [440, 940, 99_940])
def test_small_template_in_a_large_leaf(spark, others):
    """Sixty lines of one template beside other lines with the same leading tokens and length."""
    rng = random.Random(others)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnprst"]
    texts = [f"1 2 3 the backup of {a}{b}q was stored on the second disk" for a, b in itertools.islice(itertools.product(words, "xyz"), 60)]
    texts += [" ".join(["1 2 3", *rng.choices(words, k=10)]) for _ in range(others)]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_dropped > 0").select("doc_id").collect()
    assert {r.doc_id for r in got} >= set(range(1, 60)) and len(got) <= 59 + others // 1000


def test_decontamination(spark, docs, none):
    rng = random.Random(11)
    items = [[sentence(rng, 30) for _ in range(3)], "short test item", None, "", "--"]
    long_items = items[0]
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*long_items, *items[1:], "short test item"])], "item_id long, text string, doc_id string")
    swapped = long_items[1].split()
    for at in (4, 11, 17, 26):
        swapped[at] = "other"
    rows = [(1, "x y " + long_items[0].upper() + " z"), (2, "a, b. " + " ".join(swapped)), (3, long_items[2][:40]), (4, "A short, test item!"), (5, None), (6, "")]
    got = {r.doc_id: (r.contaminated, r.n_items, r.item_id, r.overlap) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: (True, 1, 0, 30), 2: (True, 1, 1, 30), 3: (False, 0, None, 0), 4: (True, 1, 3, 3), 5: (False, 0, None, 0), 6: (False, 0, None, 0)}
    assert decontaminate.clean(docs, bench).count() == docs.count()
    assert decontaminate.clean(docs, bench.limit(0)).columns == docs.columns
    assert decontaminate.contamination(none, bench).count() == 0


def test_encoder_starts_no_threads():
    """A task has one core; threads of the library's own cost time on the cores of other tasks."""
    code = """
import os
import pyarrow as pa
from mailquarry.llm.registry import tokenizer_file
from mailquarry.llm.tokens import Encoder
one = Encoder(tokenizer_file("byte_bpe_50k.json"))
before = len(os.listdir("/proc/self/task"))
one.encode(pa.array([f"word{i} and {i} more \u4e2d\u6587" for i in range(3000)] + [f"plain{i} words" for i in range(3000)]))
print(len(os.listdir("/proc/self/task")) - before)
"""
    free = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], env=free, cwd=root, capture_output=True, text=True, timeout=100, check=True)
    assert int(done.stdout.split()[-1]) == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(1)
    chars = list(" \n\t'sStTmMrRvVeElLdDaB19éß.,!-  \r")
    texts = ["", "  a  b", "it's IT'S don't", "İstanbul ſs K", "x<|endoftext|>y", "日本語 text", "a\x00b", "\r\n\r\n z", "naïve ﬁ ½ ²3"]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    encoder = Encoder(tokenizer_file(name))
    offsets, ids = encoder.encode(pa.array(texts))
    for at, text in enumerate(texts):
        assert ids[offsets[at]: offsets[at + 1]].tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 2]


def test_first_fit_decreasing():
    rng = random.Random(4)
    sizes = np.array([rng.randint(1, 100) for _ in range(500)])
    room, want = [], {}
    for at in np.argsort(-sizes, kind="stable"):
        b = next((i for i, r in enumerate(room) if r >= sizes[at]), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= sizes[at]
        want[at] = b
    assert packing.first_fit_decreasing(sizes, 100).tolist() == [want[i] for i in range(500)]


def test_packing(spark, docs, none):
    tokenizer = tokenizer_file("word_bpe_49k.json")
    parts = packing.pack(docs, tokenizer, group_bytes=50_000).collect()
    rows = rows_of(docs)
    library = Encoder(tokenizer)
    want = sorted(packing.crc32_of(library.library.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in parts:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        if p.doc_id is not None and p.doc_id != 5:
            by_doc[p.doc_id].append(p)
    for own in by_doc.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == own[0].doc_tokens
        assert zlib.crc32(b"".join(p.ids for p in own)) in want
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096 and (at & (at - 1) == 0 or 4096 - at <= packing.MOST_PADDING)
    assert sum(p.length for p in parts) == sum(len(library.library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert packing.pack(none, tokenizer).count() == 0


def test_records(spark, docs, none):
    tokenizer = tokenizer_file("byte_bpe_50k.json")
    folder = records.new_folder(spark)
    shards = records.write_records(docs, tokenizer, folder, shard_bytes=40_000)
    assert shards.count() > 1
    got = sorted(records.placed(spark, folder).collect(), key=lambda r: r.start)
    library = Encoder(tokenizer).library
    rows = rows_of(docs)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    want = sorted((str(i), packing.crc32_of(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    shard = shards.orderBy("shard").first()
    doc_id, ids = records.read_at(folder, shard.shard, shard.records - 1)
    assert (doc_id, packing.crc32_of(ids)) == (got[shard.records - 1].doc_id, got[shard.records - 1].ids_crc32)
    with pytest.raises(ValueError):
        records.record_at(records.framed(b"data")[:-1] + b"?", 0)
    assert records.write_records(none, tokenizer, records.new_folder(spark)).count() == 0


def test_language_models_are_distributions():
    pieces = language.pieces_of(pa.array(["the cat sat on the mat and the dog", "le chat est sur le tapis et la porte"]))
    half = pieces.owner < pieces.index[pieces.offsets[1]]
    lang = np.where(half, 0, 1)
    model = language.smooth(["en", "fr"], lang, pieces.codes, np.ones(len(lang), dtype=np.int64))
    context = pieces.codes[5, :-1]
    chars = [*sorted({int(c) for c in pieces.codes[:, -1]}), 0x4E00]
    p = np.exp(language.log_probabilities(model, np.array([[*context, c] for c in chars], dtype=np.uint32)))
    assert np.allclose(p.sum(axis=0), 1, atol=1e-4)


def test_language(spark, docs, none, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.identify(table, language.learned(table)).where("lang_pred = lang").count()
    assert found >= 0.95 * table.count()
    model = language.learned(docs)
    got = language.identify(docs, model)
    assert got.count() == docs.count() and set(docs.columns) < set(got.columns)
    blank = got.where("doc_id IN (100, 101, 102)").collect()
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in blank)
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.learned(none)).collect()} == {"und"}


def test_quality_counts_and_thresholds(spark, docs, none):
    text = "a b c a b c\nx # y\n\nx # y\n"
    assert quality_rules.counts_of(text)[:5] == (12, 12, 2, 1, 12)
    assert quality_rules.counts_of("one two three")[:5] == (3, 11, 0, 0, 0)
    assert abs(quality_rules.at_most(2, 10, 0.3) - 0.3827827864) < 1e-9
    assert quality_rules.strictest([0, 0, 500, 99_500], 0.01, 0.01, 3) == 3
    assert quality_rules.strictest([0, 0, 5, 5], 0.01, 0.01, 3) == 0
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality_rules.judged(docs, labels).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got if r.n_words < 50)
    assert quality_rules.judged(none, labels).count() == 0


def test_toxicity(spark, docs, none, sf):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learned(table, labels)
    toxic = toxicity.scored(table, model).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    means = {r.toxic: r.score for r in toxic.groupBy("toxic").agg(F.avg("score").alias("score")).collect()}
    assert means[1] > means[0] + 0.3
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len({i for i, _ in rows_of(docs)}) and got[100] == got[101] and all(0 <= x <= 1 for x in got.values())
    assert toxicity.scored(none, model).count() == 0
    assert {r.score for r in toxicity.scored(docs, toxicity.learned(docs, labels.limit(0))).collect()} == {0.0}


def test_site_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(50)], "doc_id long, quality int")
    got = site_quality.judged(docs, labels, F.col("source"), F.col("lang"))
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.posterior <= 1 for r in rows)
    assert site_quality.judged(none, labels, F.col("source"), F.col("lang")).count() == 0
    assert site_quality.judged(docs, labels.limit(0), F.col("source"), F.col("lang")).count() == docs.count()


def test_licenses(spark, docs, none):
    rows = [(1, "Text.\nReleased under the MIT License.\nAll rights reserved, all rights RESERVED."), (2, "cc by cc-by"), (3, None), (4, ""), (2, "cc by cc-by")]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0][:7] == (1, 12, 2, 6, 9, "reserved", "mit,reserved") and got[0].score == 1.0
    assert got[1] == got[2] and got[1][:7] == (2, 4, 2, 0, 2, "cc-by", "cc-by")
    assert all(r[1:] == (0, 0, None, None, "", "", 0.0) for r in got[3:])
    assert licenses.scanned(none).count() == 0 and licenses.scanned(docs).count() == docs.count()


def test_similarity_join_equals_brute_force(spark):
    rng = random.Random(6)
    notices = [(i, f"l{i}", rng.sample(WORDS, rng.randint(2, 9))) for i in range(12)]
    blocks = [(i, rng.sample(WORDS, rng.randint(0, 20))) for i in range(150)]
    got = licenses.matches(spark.createDataFrame(blocks, "block int, words array<string>").select("block", "words"), spark.createDataFrame(notices, "notice int, label string, words array<string>"), 0.7)
    want = {(b, n) for b, words in blocks for n, _, own in notices if len(set(own) & set(words)) >= 0.7 * len(own) - 1e-9}
    assert {(r.block, r.notice) for r in got.collect()} == want
