"""Exact dedup, filter audit and the manifest against brute force: nulls, empty tables, ties, repeats, long texts, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mailquarry.llm import exact_dedup, filter_audit, merkle
from mailquarry.llm.common import filter_bits, with_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, digest int, row long, open boolean, mask int, tree string, pos long, n long, `a.b` string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = "Apple pear PLUM fig ÄRGER ñu kiwi $5 mango Öl".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 160))) for _ in range(40)]
    out = [(i, rng.choice(texts), rng.choice(["en", "fr", "é", None])) for i in range(300)]
    out += [(400 + i, texts[0], "en") for i in range(150)]  # a large group of copies
    out += [(600, texts[1].upper(), "en"), (601, texts[1].lower(), "fr"), (602, texts[1] + "Ä", "en"), (603, texts[1] + "ä", "en")]
    out += [(610, None, "en"), (611, "", ""), (612, "", None), (613, " \n\t", "en"), (614, texts[2] * 3000, "en"), (615, (texts[2] * 3000).swapcase(), "en")]
    out += [(None, texts[3], "en"), (None, None, None), (None, "nothing like it", "fr"), (None, "nothing like it", "fr"), (5, out[5][1], out[5][2]), (616, "x", "en"), (616, "x", "en")]
    return [(i, t, lang, f"s{len(t or '')}" if (i or 0) % 9 else None, None if i == 7 else len(t or ""), "k", 1, 2, True, 3, "t", 4, 5, f"b{at}") for at, (i, t, lang) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rank(i):
    return (i is not None, i or 0)


def test_exact_duplicates(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(UPPER)].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max(ids, key=rank)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, keep, len(ids), i == keep, sha) for i in ids)
        if ids.count(keep) > 1:  # one of the repeated rows
            want[keep, keep, len(ids), True, sha] = 1
            want[keep, keep, len(ids), False, sha] = ids.count(keep) - 1
    got = exact_dedup.duplicates(docs, hash_all=True).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in got) == want
    lazily = exact_dedup.duplicates(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in lazily) == Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert all(r.digest for r in lazily if r.group_size > 1) and not all(r.digest for r in lazily)
    assert exact_dedup.duplicates(none).count() == 0


def test_rows_without_copies_keep_their_columns(docs, rows, none):
    got = exact_dedup.without_copies(docs)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    found = [tuple(r) for r in got.collect()]
    assert set(found) <= set(rows) and len(found) == len({(r[1] or "").translate(UPPER) for r in rows})
    most = {}
    for r in rows:
        text = (r[1] or "").translate(UPPER)
        most[text] = max(most.get(text, (False, 0)), rank(r[0]))
    assert all(rank(r[0]) == most[(r[1] or "").translate(UPPER)] for r in found)
    assert exact_dedup.without_copies(none).count() == 0


def test_a_full_filter_only_costs_work(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.duplicates(docs, hash_all=True).select("doc_id", "keep_id", "group_size", "kept").collect()))
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda n: 6)
    monkeypatch.setattr(exact_dedup, "LENGTH_BITS", 6)
    assert sorted(map(str, exact_dedup.duplicates(docs, hash_all=True).select("doc_id", "keep_id", "group_size", "kept").collect())) == want
    assert filter_bits(0) == 16 and filter_bits(1 << 20) == 24 and filter_bits(1 << 40) == 26


def test_groups_of_all_sizes_join(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"))
    groups = spark.createDataFrame([(0, 1500, "hot")] + [(k, 0, "cold") for k in range(2000, 2500)], "k long, n long, v string")
    got = Counter(r.v for r in with_groups(rows, groups, "k", "n").collect())
    assert got == {"hot": 1500, "cold": 500, None: 1000}


def failing(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {x for x, fails in zip("ABCD", (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text)), strict=True) if fails}


def test_audit_equals_running_the_filters(spark, docs, rows, none):
    labels = [(i, q, t) for i, q, t in ((i, i % 2, int(i % 5 == 0)) for i in range(0, 450, 3))] + [(3, 1, 1), (9, None, None), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in labels if q and i is not None}, {i for i, _, t in labels if t and i is not None}
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    found = defaultdict(list)
    for r in rows:
        again = r[0] is not None and r[0] > first[r[1] or ""]
        found[r[2] or ""].append((r[0], failing(r[1] or "") | ({"E"} if again else set())))
    want, shapley = {}, Counter()
    for part, own in found.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[part, x] += len(gone)
                want[part, order, step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    got = filter_audit.audited(docs, marks).collect()
    assert len(got) == len(want) == 600 * len(found)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]] and r.filter == r.filter_order[r.step - 1]
    assert filter_audit.audited(none, marks).count() == 0
    assert filter_audit.audited(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, at, digest):
    """(root, proof, folded) by plain levels."""
    proof, folded = [], digest
    while len(nodes) > 1:
        run = nodes[at // 2 * 2: at // 2 * 2 + 2]
        proof += [x for k, x in enumerate(run) if k != at % 2]
        folded = sha(*(folded if k == at % 2 else x for k, x in enumerate(run)))
        nodes, at = [sha(*nodes[i: i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], proof, folded


def brute_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        i, text, lang, source, n = r[:5]
        leaf = framed((i, source, lang, n, text))
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        trees[lang].append((rank(i), leaf, i, framed((i, source, lang, n + 1, text)) if hit else leaf))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted(trees[x], key=lambda y: y[:2]) for x in langs}
    subroots = [climb([y[1] for y in own[x]], 0, "")[0] for x in langs]
    out = Counter()
    for at, x in enumerate(langs):
        for k, (_, leaf, i, start) in enumerate(own[x]):
            _, low, folded = climb([y[1] for y in own[x]], k, start)
            root, high, folded = climb(subroots, at, folded)
            out[i, leaf, subroots[at], root, sha(*low, *high), folded, folded == root] += 1
    return out


@pytest.mark.parametrize("stride", [8, 2, 1])
def test_manifest(docs, rows, none, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "BLOCK", 1 << stride)
    tampered, changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(38,0)") + 1

    def of(table):
        return Counter(tuple(r) for r in merkle.manifest(table, tampered, changed).collect())

    repeated = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) > 1}
    got, want = of(docs), brute_manifest(rows)
    assert got == want and {x[-1] for x in got} == {True, False} and repeated
    if stride == 2:
        one = docs.where("doc_id = 30")
        assert of(one) == brute_manifest([tuple(r) for r in one.collect()])
        assert not of(none)
        some = docs.where("lang = 'en'").limit(17)
        some = some.sparkSession.createDataFrame(some.collect(), SCHEMA)
        assert of(some) == brute_manifest([tuple(r) for r in some.collect()])
    if stride == 1:
        many = docs.sparkSession.createDataFrame([(i, "t", f"l{i % 37}", "s", i) + (None,) * 9 for i in range(200)], SCHEMA)
        assert of(many) == brute_manifest([tuple(r) for r in many.collect()])
